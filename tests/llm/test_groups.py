"""Connected groups and survivors against brute force."""

import random

from pyspark.sql import functions as F

from plumbline.llm import components, survivors


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def groups(spark, links):
    return {r.v: r.group for r in components.connected_groups(spark.createDataFrame(links, "a string, b string")).collect()}


def test_chain_star_random(spark, monkeypatch):
    rnd = random.Random(5)
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    star = [("hub", f"s{i:04d}") for i in range(300)]
    loose = [(str(rnd.randint(0, 400)), str(rnd.randint(0, 400))) for _ in range(300)]
    links = chain + star + loose + [(b, a) for a, b in chain[:50]]
    assert groups(spark, links) == brute(links)
    # With salted edges of the hub.
    monkeypatch.setattr(components, "LEAST_HOT", 100)
    assert groups(spark, star + chain[:20]) == brute(star + chain[:20])


def test_no_links(spark):
    assert groups(spark, [("a", "a"), (None, "b"), ("c", None)]) == {}


def test_duplicate_groups(spark):
    rows = [(1, "A-1", "x"), (1, "B-1", "y"), (2, "A-2", "y"), (2, "B-2", "z"), (3, "A-3", "q"), (3, "B-3", None), (4, "A-4", "r"), (4, "B-4", "r"), (5, "A-5", "s"), (5, "B-5", ""), (1, "A-1", "x"), (6, "B-6", "x"), (6, "A-6", "y"), (None, "A-7", "k"), (None, "B-7", "l"), (8, None, "m"), (8, "B-8", "n")]
    df = spark.createDataFrame(rows, "pair_no long, mark string, code string").withColumns({"v": F.lit(1), "group": F.lit(2), "side": F.lit(3)})
    assert {tuple(r) for r in components.duplicate_groups(df).collect()} == {("x", "x"), ("y", "x"), ("z", "x")}
    assert components.duplicate_groups(df.limit(0)).count() == 0


MATERIAL = "code string, creator string, price string, manufacturer string, lead_time string, modify_date string"


def survivors_of(spark, rows, members, **kw):
    material = spark.createDataFrame(rows, MATERIAL).withColumns({"day": F.lit(1), "g": F.lit(2), "value": F.lit(3)})
    member = spark.createDataFrame(members, "dup_group long, code string")
    ref = spark.createDataFrame([("mdm_01", 1), ("eng", 2), ("Eng ", 3), (None, 1)], "creator string, trust_rank int")
    return {(r.g, r.field): r.code for r in survivors.surviving(survivors.material_claims(member, material, ref), **kw).collect()}


def test_survivors(spark):
    rows = [
        ("a", "eng", "1.0", "X", "7", "2024-01-01 23:00:00"), ("b", " MDM_01", "0", "-", None, "2024/1/1"), ("c", "nobody", "待定", "Y", "N/A", "20240102"), ("d", "?", "¥2.0", "", "3天", None), ("d", "?", "¥2.0", "", "3天", None),
        ("e", "eng", "5", "未知", "-", "-"), ("f", "mdm_01", "6", "", "", ""),
    ]
    got = survivors_of(spark, rows, [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "a"), (2, "e"), (2, "f"), (3, "missing"), (None, "a"), (4, None)])
    assert got == {(1, "creator"): "c", (1, "price"): "a", (1, "manufacturer"): "c", (1, "lead_time"): "a", (2, "creator"): "f", (2, "price"): "f"}


def test_learned_precedence(spark):
    rows = [(f"o{i}", "eng", "1", "Old", "7", f"2024-01-{i + 1:02d}") for i in range(5)] + [(f"n{i}", "eng", "1", "New", "7", f"2024-02-{i + 1:02d}") for i in range(5)]
    rows += [("u1", "mdm_01", "1", "Old", "7", None), ("u2", "eng", "1", "New", "7", None), ("u3", "eng", "1", "Old", "7", "2024-05-01")]
    members = [(i, f"o{i}") for i in range(5)] + [(i, f"n{i}") for i in range(5)] + [(10, "u1"), (10, "u2"), (11, "u3"), (11, "u2")]
    plain, learned = survivors_of(spark, rows, members), survivors_of(spark, rows, members, undated="learned")
    assert plain[(10, "manufacturer")] == "u1" and learned[(10, "manufacturer")] == "u2"
    assert plain[(11, "manufacturer")] == "u3" and learned[(11, "manufacturer")] == "u2"
    assert all(learned[(i, "manufacturer")] == f"n{i}" for i in range(5))
    assert survivors_of(spark, rows[:0] + [("zz", None, None, None, None, None)], [(1, "zz")]) == {}


def test_rules_first_then_precedence(spark):
    """One key with two records of one day and creator: no rule orders their values, the learned precedence does."""
    rows = [(f"o{i}", "eng", "1", "Old", "7", f"2024-01-{i + 1:02d}") for i in range(5)] + [(f"n{i}", "eng", "1", "New", "7", f"2024-02-{i + 1:02d}") for i in range(5)]
    rows += [("t", "eng", "1", "Old", "7", "2024-05-01"), ("t", "eng", "1", "New", "7", "2024-05-01"), ("a", "eng", "1", "Zed", "7", "2024-04-01")]
    material = spark.createDataFrame(rows, MATERIAL)
    member = spark.createDataFrame([(i, f"{c}{i}") for i in range(5) for c in "on"] + [(9, "t"), (9, "a")], "dup_group long, code string")
    ref = spark.createDataFrame([], "creator string, trust_rank int")
    for undated in ("oldest", "learned"):
        got = {(r.g, r.field): (r.code, r.value) for r in survivors.surviving(survivors.material_claims(member, material, ref), undated=undated).collect()}
        assert got[(9, "manufacturer")] == ("t", "New" if undated == "oldest" else min("New", "Old"))
        assert all(got[(i, "manufacturer")] == (f"n{i}", "New") for i in range(5))


def test_a_pair_number_of_many_codes(spark):
    """Links grow with the codes, not with their product, and connect the same."""
    rows = [(1, "A-1", f"a{i:03d}") for i in range(200)] + [(1, "B-1", f"b{i:03d}") for i in range(200)] + [(2, "A-2", "p"), (2, "B-2", "p"), (2, "B-2", "q"), (3, "A-3", "r"), (3, "B-3", "r")]
    df = spark.createDataFrame(rows, "pair_no long, mark string, code string")
    assert components.pair_links(df).count() <= 402
    got = {r.code: r.group_code for r in components.duplicate_groups(df).collect()}
    assert got == {c: "a000" for _, _, c in rows[:400]} | {"p": "p", "q": "p"}


def test_hot_vertex_is_spread(spark, monkeypatch):
    """A vertex with a third of all links is cut into as many parts as it has shares, and none of the join's tasks gets the whole of it."""
    monkeypatch.setattr(components, "LEAST_HOT", 50)
    edges = spark.range(3000).selectExpr("if(id % 3 = 0, 0L, id) a", "id + 10000 b")
    degrees = edges.selectExpr("a v").groupBy("v").count()
    hot = components._hot(degrees, "v", 3000)
    salts = {r.key: r.salts for r in hot.collect()}
    assert salts == {0: 1000 // max(50, 3000 // (8 * 4)) + 1}
    table = edges.select("a").distinct().selectExpr("a v", "a * 2 c")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = components._looked_up(edges, "a", table, hot)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 3000 and max(sizes) < 1200 and joined.where("c <> a * 2").count() == 0


def test_codes_by_the_rules_alone(spark, tmp_path, monkeypatch):
    """p7_found learns no precedence, as its codes cannot depend on one; it gives the codes of ``surviving``, also where learned edges close a circle."""
    from plumbline.llm import queries

    rnd = random.Random(7)
    rows = [(f"c{rnd.randint(0, 59):02d}", rnd.choice(["eng", "mdm_01", "x", None]), rnd.choice("123"), rnd.choice("PQRS"), rnd.choice("78"), rnd.choice([None, "", *(f"2024-01-{d:02d}" for d in range(1, 7))])) for _ in range(300)]
    # One code with two values of one day: Q follows P, R follows Q, P follows R elsewhere.
    rows += [(f"{a}{d}", "eng", "1", v, "7", f"2024-01-{d:02d}") for a, vs in (("e", "PQ"), ("f", "QR"), ("h", "RP")) for d, v in enumerate(vs, 1)] + [("z", "eng", "1", v, "7", "2024-02-01") for v in "PQR"]
    members = [(rnd.randint(0, 15), f"c{i:02d}") for i in range(60)] + [(20 + i, f"{a}{d}") for i, a in enumerate("efh") for d in (1, 2)] + [(30, "z"), (30, "e1")]
    tables = {"material": (rows, MATERIAL), "dup_member": (members, "dup_group long, code string"), "creator_ref": ([("mdm_01", 1), ("eng", 2)], "creator string, trust_rank int")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    want = {(r.g, r.field, r.code) for r in survivors.surviving(queries._claims(spark, str(tmp_path))).collect()}
    assert (30, "manufacturer", "z") in want and len(want) > 60
    monkeypatch.delattr(survivors, "precedence")
    got = queries.p7_found(spark, str(tmp_path))
    assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want
