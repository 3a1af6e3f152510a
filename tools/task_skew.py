"""Per-stage task record counts from a Spark event log folder: the largest
task's share of the records shows whether a stage is skewed."""
import json, sys, glob, os, collections
logs = sorted(glob.glob(sys.argv[1] + "/eventlog_v2_*/events_*"), key=os.path.getmtime)
import itertools
last_dir = os.path.dirname(logs[-1]); logs = sorted(glob.glob(last_dir + "/events_*"))
stages = collections.defaultdict(list); names = {}
import io, zstandard
def lines(p):
    if p.endswith(".zstd"):
        with open(p, "rb") as f:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(f), encoding="utf-8")
    else:
        yield from open(p)
for line in itertools.chain.from_iterable(lines(p) for p in logs):
    e = json.loads(line)
    if e.get("Event") == "SparkListenerTaskEnd":
        m = e.get("Task Metrics") or {}
        recs = (m.get("Input Metrics", {}).get("Records Read", 0) +
                m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
        stages[e["Stage ID"]].append((recs, e["Task Info"]["Finish Time"] - e["Task Info"]["Launch Time"]))
    if e.get("Event") == "SparkListenerStageCompleted":
        names[e["Stage Info"]["Stage ID"]] = e["Stage Info"]["Stage Name"][:40]
print(f"{'stage':>5} {'tasks':>5} {'records':>10} {'max_task':>9} {'max_share':>9} {'max_ms':>7}  name")
for s, ts in sorted(stages.items()):
    tot = sum(r for r, _ in ts)
    mx = max(r for r, _ in ts)
    if tot < 1000: continue
    print(f"{s:5d} {len(ts):5d} {tot:10d} {mx:9d} {mx/tot:9.2f} {max(t for _, t in ts):7d}  {names.get(s,'')}")
