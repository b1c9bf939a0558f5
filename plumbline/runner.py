"""Running a user's script beside the engine: a subprocess with a time limit, cut output and a record of the run."""

from __future__ import annotations

import json
import subprocess
import sys
import time
from pathlib import Path

#: Bytes of output that are kept.
OUTPUT_BYTES = 64 * 1024


def cut(data: bytes, most: int = OUTPUT_BYTES) -> tuple[str, bool]:
    """Text of at most ``most`` bytes without half a character, and whether anything was cut."""
    return data[:most].decode("utf-8", "ignore"), len(data) > most


def run_script(code: str, *, timeout_s: float = 60, audit: str | None = None, keep: int = 100, python: str = sys.executable) -> dict:
    """Run Python code; the record has exit code, duration, output, and whether it was cut or timed out."""
    start = time.time()
    try:
        done = subprocess.run([python, "-c", code], capture_output=True, timeout=timeout_s)
        out, err, exit_code, timed_out = done.stdout, done.stderr, done.returncode, False
    except subprocess.TimeoutExpired as e:
        out, err, exit_code, timed_out = e.stdout or b"", e.stderr or b"", -1, True
    (stdout, cut_out), (stderr, cut_err) = cut(out), cut(err)
    record = {"timestamp": start, "exit_code": exit_code, "duration_s": round(time.time() - start, 3), "stdout": stdout, "stderr": stderr, "output_truncated": cut_out or cut_err, "timed_out": timed_out, "script": code}
    if audit:
        folder = Path(audit)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"run-{time.time_ns()}.json").write_text(json.dumps(record), encoding="utf-8")
        for old in sorted(folder.glob("run-*.json"))[:-keep]:
            old.unlink()
    return record
