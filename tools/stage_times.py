"""Summarise a Spark event log: per SQL execution, its stages, tasks, stage
time and shuffle bytes. Usage: python tools/stage_times.py <event-log-file-or-dir>

Run the bench with BENCH_EVENT_LOG=<scratch dir> to write the log (the Spark
UI stays off; the log is a plain JSON-lines file).
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def _files(path: str) -> list[str]:
    """Event log files under ``path`` (Spark writes rolling logs as folders of
    ``events_<n>_<app>[.zstd]`` files)."""
    if not os.path.isdir(path):
        return [path]
    out = []
    for root, _, names in os.walk(path):
        out += [os.path.join(root, n) for n in sorted(names)
                if not n.startswith((".", "appstatus"))]
    return sorted(out)


def _lines(path: str):
    if path.endswith(".zstd"):
        import io
        import zstandard
        with open(path, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path) as fh:
            yield from fh


def main() -> None:
    exec_desc: dict[int, str] = {}
    job_exec: dict[int, int] = {}
    stage_job: dict[int, int] = {}
    per_exec = defaultdict(lambda: {"stages": 0, "tasks": 0, "stage_ms": 0, "shuffle_read": 0,
                                    "shuffle_write": 0, "spill": 0})
    for f in _files(sys.argv[1]):
        for line in _lines(f):
            ev = json.loads(line)
            kind = ev.get("Event", "")
            if kind.endswith("SQLExecutionStart"):
                exec_desc[ev["executionId"]] = ev.get("description", "")[:60]
            elif kind == "SparkListenerJobStart":
                eid = (ev.get("Properties") or {}).get("spark.sql.execution.id")
                if eid is not None:
                    job_exec[ev["Job ID"]] = int(eid)
                    for sid in ev.get("Stage IDs", []):
                        stage_job[sid] = ev["Job ID"]
            elif kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                job = stage_job.get(info["Stage ID"])
                if job is None or job not in job_exec:
                    continue
                row = per_exec[job_exec[job]]
                row["stages"] += 1
                row["tasks"] += info.get("Number of Tasks", 0)
                if info.get("Submission Time") and info.get("Completion Time"):
                    row["stage_ms"] += info["Completion Time"] - info["Submission Time"]
                for acc in info.get("Accumulables", []):
                    name, val = acc.get("Name", ""), acc.get("Value", 0)
                    try:
                        val = int(val)
                    except (TypeError, ValueError):
                        continue
                    if name == "internal.metrics.shuffle.read.remoteBytesRead" or \
                            name == "internal.metrics.shuffle.read.localBytesRead":
                        row["shuffle_read"] += val
                    elif name == "internal.metrics.shuffle.write.bytesWritten":
                        row["shuffle_write"] += val
                    elif name == "internal.metrics.diskBytesSpilled":
                        row["spill"] += val
    print(f"{'exec':>5} {'stages':>6} {'tasks':>6} {'stage_ms':>9} {'shuf_rd_MB':>10} "
          f"{'shuf_wr_MB':>10} {'spill_MB':>8}  description")
    for eid in sorted(per_exec):
        r = per_exec[eid]
        print(f"{eid:>5} {r['stages']:>6} {r['tasks']:>6} {r['stage_ms']:>9} "
              f"{r['shuffle_read'] / 1e6:>10.1f} {r['shuffle_write'] / 1e6:>10.1f} "
              f"{r['spill'] / 1e6:>8.1f}  {exec_desc.get(eid, '')}")


if __name__ == "__main__":
    main()
