import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from foliomill.operators import line_items, review, state_store
from foliomill.operators.history import look_back
from foliomill.session import shared_folder
from foliomill.streaming import review_stream

ACTIONS = "job_id string, at bigint, seq bigint, action string, feedback string"


def make_actions(seed=3, n=600):
    """One job holds more than a third of all rows; some times are equal."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        job = "hot" if rng.random() < 0.4 else f"j{rng.randint(0, 20)}"
        action = rng.choice(["submit", "approve", "reject"])
        rows.append((job, 1000 + seq // 2 * 7, seq, action, rng.choice(["", "note"])))
    return rows


def walk(rows):
    """Outcome of each action, one after the other."""
    status, out = {}, {}
    for job, _, seq, action, feedback in sorted(rows, key=lambda r: (r[1], r[2])):
        if action == "submit":
            status[job], out[seq] = "review", "submitted"
        elif action == "reject" and not feedback:
            out[seq] = "invalid"
        elif job not in status:
            out[seq] = "not_found"
        elif status[job] != "review":
            out[seq] = "conflict"
        else:
            status[job], out[seq] = ("complete", "approved") if action == "approve" else ("failed", "rejected")
    return status, out


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    """The same rows in one range and in several."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(old, (str(request.param), "false", "16"), strict=True):
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_look_back_across_ranges(spark, ranges):
    """A hot group, a burst of equal times in it, groups without a key, and odd values."""
    rng = random.Random(9)
    groups = [("hot", 1.0), ("b", None), (None, None), ("hot", float("nan")), ("z", 0.0)]
    rows = [(*rng.choices(groups, [9, 1, 1, 1, 1])[0], 5 if rng.random() < 0.6 else rng.randrange(50), i, rng.choice([None, "p", "q"]), [i]) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, h double, t bigint, seq int, v string, w array<int>").repartition(5)
    out = look_back(df, ["g", "h"], "t", ["seq"], previous={"before": "v", "list_before": "w"}, seen={"had": (F.col("v") == "q") & (F.col("t") != 5), "any": F.lit(True)})
    got = {r.seq: (r.before, r.list_before, r.had, r["any"]) for r in out.collect()}
    assert len(got) == len(rows)
    walked = {}
    for g, h, t, seq, v, w in sorted(rows, key=lambda r: (r[2], r[3])):
        mine = walked.setdefault((g, str(h)), [])
        assert got[seq] == (mine[-1][0] if mine else None, mine[-1][1] if mine else None, any(x[0] == "q" and x[2] != 5 for x in mine), bool(mine))
        mine.append((v, w, t))
    assert look_back(df.limit(0), ["g"], "t", [], previous={"before": "v"}).collect() == []


def test_look_back_reads_twice_and_refuses_clashes(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    out = look_back(events, ["user_id"], "at", ["event_id"], previous={"old": "value"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and plan.count("FileScan parquet") == 3 and "SortMergeJoin" not in plan
    with pytest.raises(ValueError, match="exist"):
        look_back(events, ["user_id"], "at", [], previous={"VALUE": "value"})


def test_lifecycle_equals_walk(spark, ranges):
    rows = make_actions()
    status, want = walk(rows)
    outcome = review.outcomes(spark.createDataFrame(rows, ACTIONS).repartition(4))
    assert {r.seq: r.outcome for r in outcome.collect()} == want
    assert {r.job_id: r.status for r in review.job_states(outcome).collect()} == status


def run_stream(spark, source, folder, **kw):
    stream = spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = review_stream.start(stream, folder, available_now=True, **kw)
    query.awaitTermination()
    return query


def write_parts(spark, rows, source, parts):
    size = len(rows) // parts
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], ACTIONS).coalesce(1).write.mode("append").parquet(str(source))


def test_stream_in_batches_equals_walk(spark, tmp_path):
    rows = make_actions(5, 240)
    status, want = walk(rows)
    source, folder = tmp_path / "in", shared_folder(spark, "review")
    write_parts(spark, rows, source, 6)
    query = run_stream(spark, source, folder)
    assert len([p for p in query.recentProgress if p.numInputRows]) == 6
    assert {r.seq: r.outcome for r in review_stream.read_outcomes(spark, folder).collect()} == want
    assert {r.job_id: r.status for r in review_stream.current(spark, folder).collect()} == status
    # The batch twin gives the same outcomes.
    twin = review.outcomes(spark.createDataFrame(rows, ACTIONS))
    assert {r.seq: r.outcome for r in twin.collect()} == want

    # A restart goes on from the kept state, and touches the state of the jobs it meets only.
    more = [(job, at + 10**6, seq + 240, action, feedback) for job, at, seq, action, feedback in make_actions(6, 60) if job in ("hot", "j1", "j2")]
    _, want = walk(rows + more)
    write_parts(spark, more, source, 1)
    query = run_stream(spark, source, folder)
    got = {r.seq: r.outcome for r in review_stream.read_outcomes(spark, folder).collect()}
    assert got == want
    updated = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.numInputRows]
    assert len(updated) == 1 and updated[0] <= 3


def test_forgotten_jobs_are_not_found(spark, tmp_path):
    source, folder = tmp_path / "in", shared_folder(spark, "review")
    write_parts(spark, [("a", 1, 1, "submit", "")], source, 1)
    run_stream(spark, source, folder, ttl_ms=1)
    write_parts(spark, [("a", 2, 2, "approve", "")], source, 1)
    run_stream(spark, source, folder, ttl_ms=1)
    assert {r.seq: r.outcome for r in review_stream.read_outcomes(spark, folder).collect()} == {1: "submitted", 2: "not_found"}


def test_guard(spark):
    jobs = spark.createDataFrame([("a", "review", True), ("b", "complete", False)], "job_id string, status string, requires_review boolean")
    rows = [("a", "approve", ""), ("a", "reject", ""), ("a", "reject", "why"), ("b", "approve", ""), ("c", "approve", "")]
    out = review.guard(spark.createDataFrame(rows, "job_id string, action string, feedback string"), jobs)
    assert sorted(r.verdict for r in out.collect()) == ["conflict", "invalid", "not_found", "ok", "ok"]
    assert sorted(r.status for r in review.apply_decisions(out).collect()) == ["complete", "failed"]


def test_change_over_time(spark):
    rows = spark.createDataFrame([("x", 1, 100.0), ("x", 2, 118.0), ("x", 3, 0.0), ("x", 4, 5.0), ("y", 1, 200.0), ("y", 2, 150.0)], "g string, t bigint, v double")
    out = line_items.change_over_time(rows, ["g"], "t", [], "v")
    got = {(r.g, r.t): (r.pct_change, r.change_error) for r in out.collect()}
    assert got["x", 2] == (18.0, False) and got["y", 2] == (-25.0, False)
    assert got["x", 4] == (None, True) and got["x", 1] == (None, False)


def test_versions_snapshots_and_rollback(spark):
    folder = shared_folder(spark, "state")
    schema = "job_id string, version bigint, state string"
    state_store.append(spark.createDataFrame([("a", 1, "one"), ("b", 1, "b1")], schema), folder, "1")
    versions = lambda: spark.read.parquet(folder).select("job_id", "version", "state")
    asked = spark.createDataFrame([("a",), ("z",)], "job_id string")
    taken, missing = state_store.snapshot(asked, versions(), F.lit(10))
    taken = spark.createDataFrame(taken.collect(), taken.schema)
    assert [r.error for r in missing.collect()] == ["No state found for job z"]
    for _ in range(2):  # a repeated run adds nothing
        state_store.append(spark.createDataFrame([("a", 2, "two")], schema), folder, "2")
    assert {r.job_id: r.state for r in state_store.load(asked, versions()).collect()} == {"a": "two", "z": None}
    wanted = [("a", taken.first().snapshot_id, 1), ("a", "nope", 2)]
    back, misses = state_store.rollback(spark.createDataFrame(wanted, "job_id string, snapshot_id string, turn int"), taken, versions())
    assert misses.count() == 1
    state_store.append(back.select("job_id", "version", "state"), folder, "3")
    assert {r.job_id: r.state for r in state_store.latest(versions()).collect()} == {"a": "one", "b": "b1"}
    state_store.compact(versions(), f"{folder}-compact")
    assert spark.read.parquet(f"{folder}-compact").count() == 2


def test_bucketed_versions_stay_where_they_are(spark):
    folder = shared_folder(spark, "versions")
    rows = [(f"j{i % 40}", i, f"s{i}") for i in range(400)]
    schema = "job_id string, version bigint, state string"
    table = "versions_" + folder.rsplit("-", 1)[-1]
    state_store.create_table(spark.createDataFrame(rows[:200], schema), table, folder, 4)
    versions = state_store.extend(spark.createDataFrame(rows[200:], schema), table, 4)
    asked = spark.createDataFrame([("j1",), ("j39",), ("zz",)], "job_id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        loaded = state_store.load(asked, versions)
        assert {r.job_id: r.state for r in loaded.collect()} == {"j1": "s361", "j39": "s399", "zz": None}
        plan = loaded._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        # Every exchange stands above the requests, none above the versions.
        assert "Bucketed: true" in plan
        assert plan.count("Exchange hashpartitioning") == plan.count("Scan ExistingRDD") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_state_taken_twice_restores_once(spark):
    versions = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two")], "job_id string, version bigint, state string")
    asked = versions.select("job_id").distinct()
    early, late = (state_store.snapshot(asked, versions, F.lit(at))[0] for at in ("10", "11"))
    ids = [r.snapshot_id for s in (early, late) for r in s.collect()]
    assert len(set(ids)) == 2
    taken = early.union(late).union(late)
    requests = spark.createDataFrame([("a", ids[0], 1), ("a", ids[1], 2), ("a", ids[1], 2)], "job_id string, snapshot_id string, turn int")
    restored, misses = state_store.rollback(requests, taken, versions)
    assert sorted((r.version, r.state) for r in restored.collect()) == [(3, "two"), (4, "two")]
    assert misses.count() == 0


def test_hot_invoice_lines(spark):
    """One invoice holds most lines."""
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else f"i{i % 9}", i, rng.choice(["Pen", " pen", "Ink", ""]), 2.0, 1.25, rng.choice([2.5, 2.51, 2.52])) for i in range(400)]
    lines = spark.createDataFrame(rows, "job_id string, line bigint, description string, qty double, unit_price double, total double")
    seen, repeats, wrong = set(), set(), set()
    for job, line, name, _, _, total in rows:
        key = (job, name.strip().lower())
        if key[1] and key in seen:
            repeats.add((job, line))
        seen.add(key)
        if total > 2.511:
            wrong.add((job, line))
    marked = line_items.mark_repeats(lines, "line").filter("repeated")
    assert sorted((r.job_id, r.line) for r in marked.collect()) == sorted(repeats)
    assert {(r.job_id, r.line) for r in line_items.math_errors(lines).collect()} == wrong
    n = {j: sum(r[0] == j for r in rows) for j in {r[0] for r in rows}}
    heads = spark.createDataFrame([(j, 1.0, 2.5 * k + 1.0) for j, k in n.items()] + [("none", 0.0, 0.01)], "job_id string, tax double, grand_total double")
    got = {r.job_id: r for r in line_items.invoice_checks(heads, lines).collect()}
    assert all(got[j].grand_total_correct and got[j].lines == k for j, k in n.items())
    assert not got["none"].grand_total_correct and got["none"].line_item_math
    assert sum(r.repeated_lines for r in got.values()) == len(repeats)


def test_repeats_keep_rows_without_a_job(spark):
    rows = [(None, 1, "bolt"), (None, 2, "Bolt"), ("a", 1, "nut")]
    lines = spark.createDataFrame(rows, "job_id string, position int, description string")
    got = line_items.mark_repeats(lines).collect()
    assert sorted((r.job_id or "", r.position, r.repeated) for r in got) == [("", 1, False), ("", 2, True), ("a", 1, False)]
