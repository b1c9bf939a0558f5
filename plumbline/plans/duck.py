"""Pieces of SQL that several modules share."""

from plumbline.functions.text import PLACEHOLDERS


def day(column: str) -> str:
    """The day of a text in several notations, as ``plumbline.functions.dates.parse_day`` reads it."""
    x = f"trim({column})"
    return rf"""(CASE
      WHEN regexp_full_match({x}, '\d{{1,2}}\.\d{{1,2}}\.\d{{4}}') THEN try_cast(regexp_replace({x}, '^(\d+)\.(\d+)\.(\d+)$', '\3-\2-\1') AS DATE)
      WHEN regexp_matches({x}, '^\d{{4}}[-/.年]\d{{1,2}}[-/.月]\d{{1,2}}') THEN try_cast(regexp_extract(regexp_replace({x}, '[/.年月]', '-', 'g'), '^\d+-\d+-\d+') AS DATE)
      WHEN regexp_full_match({x}, '\d{{8}}') THEN try_cast(regexp_replace({x}, '^(\d{{4}})(\d\d)(\d\d)$', '\1-\2-\3') AS DATE)
      WHEN regexp_full_match({x}, '\d{{1,6}}') THEN DATE '1899-12-30' + CAST({x} AS INTEGER) END)"""


def unfilled(column: str) -> str:
    """Whether a text is blank or a placeholder, as ``plumbline.functions.text.is_unfilled`` reads it."""
    words = ", ".join("'" + w + "'" for w in PLACEHOLDERS)
    return rf"(lower(regexp_replace(translate(coalesce({column}, ''), '／－？＊．　', '/-?*. '), '[\s\x{{85}}\x{{A0}}\x{{AD}}\x{{1680}}\x{{180E}}\x{{2000}}-\x{{200F}}\x{{2028}}-\x{{202F}}\x{{205F}}-\x{{2064}}\x{{3000}}\x{{FEFF}}]', '', 'g')) IN ('', {words}))"
