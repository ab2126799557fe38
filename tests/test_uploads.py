import json
import random

import pytest
from pyspark.sql import functions as F

from flowsentry.functions import uploads as U
from flowsentry.operators.uploads import SourceState, dedupe_uploads
from flowsentry.session import scratch_path
from flowsentry.streaming.dedup import dedupe_stream
from flowsentry.streaming.pipeline import append_stream, fresh_checkpoint

SCHEMA = (
    "arrival long, tenant_id string, source_id string, file_epoch string, start_offset long, end_offset long, "
    "batch_hash string, content_hash string"
)


def _walk(rows):
    states, out = {}, {}
    for r in sorted(rows):
        state = states.setdefault((r[1], r[2]), SourceState())
        out[r[0]] = state.offer(r[3], r[4], r[5], r[6], r[7])
    return out


def _log(n, seed):
    """Half of the log comes from one source, and a third of it is one content."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.5 else f"s{rng.randrange(6)}"
        start = rng.randrange(60) * 10
        content = "copy" if rng.random() < 0.33 else f"c{rng.randrange(40)}"
        rows.append((i, f"t{i % 2}", source, f"e{rng.randrange(2)}", start, start + rng.randrange(1, 400), f"b{rng.randrange(60)}", content))
    return rows


def _result(df):
    return {r["arrival"]: (r["decision"], r["effective_start_offset"], r["reason"]) for r in df.collect()}


def test_every_outcome():
    s = SourceState()
    assert s.offer("e", 0, 100, "b1", "c1") == ("forward", 0, None)
    assert s.offer("e", 0, 100, "b9", "c1") == ("drop_duplicate", 0, "content_hash_match")
    assert s.offer("f", 0, 500, "b9", "c1") == ("drop_duplicate", 0, "content_hash_match")
    assert s.offer("e", 0, 500, "b1", "c2") == ("drop_duplicate", 0, "batch_hash_match")
    assert s.offer("e", 10, 100, "b2", "c2") == ("drop_stale", 10, None)
    assert s.offer("e", 50, 150, "b2", "c2") == ("trim_overlap", 100, None)
    assert s.offer("e", 150, 160, "b3", "c3") == ("forward", 150, None)
    assert s.offer("f", 0, 10, "b1", "c4") == ("forward", 0, None)


def test_batch_form_equals_the_walk(spark):
    rows = _log(1500, 4)
    want = _walk(rows)
    assert {"forward", "trim_overlap", "drop_stale", "drop_duplicate"} == {v[0] for v in want.values()}
    assert {"content_hash_match", "batch_hash_match", None} == {v[2] for v in want.values()}
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
    assert _result(dedupe_uploads(df)) == want


def test_stream_form_equals_the_walk_over_several_triggers(spark, tmp_path):
    rows = _log(400, 9)
    folder = tmp_path / "in"
    folder.mkdir()
    names = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    stream = dedupe_stream(
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    )
    out, checkpoint = scratch_path(spark, "dedup"), fresh_checkpoint(stream, "dedup")
    for part in range(4):
        chunk = rows[part * 100 : part * 100 + 100]
        random.Random(part).shuffle(chunk)
        (folder / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in chunk))
        # Each start resumes from the checkpoint, as after a lost driver.
        append_stream(stream, out, checkpoint).awaitTermination()
    assert _result(spark.read.parquet(out)) == _walk(rows)


def test_names_and_checks(spark):
    df = spark.createDataFrame(
        [("a b/ü.pcap", "f" * 64, -1, 5, "t", "alert.tenant.x.y"), (None, "0" * 64, 5, 5, " ", "alert.tenant.x"), ("x", "0" * 64, 1, 5, "t", "other")],
        "f string, h string, s long, e long, tenant string, topic string",
    )
    got = df.select(
        U.stored_name(F.col("f"), F.col("h")),
        U.reject_reason(F.col("tenant"), F.lit("src"), F.col("s"), F.col("e")),
        U.tenant_of(F.nullif("tenant", F.lit("t")), F.col("topic")),
        U.topic_matches(F.col("topic"), "alert.tenant.*"),
    ).collect()
    assert [r[0] for r in got] == ["ffffffffffff__.pcap", "000000000000_upload.pcap", "000000000000_x"]
    assert [r[1] for r in got] == ["offsets must be non-negative", "end_offset must be greater than start_offset", None]
    assert [r[2] for r in got] == ["x.y", " ", "unknown_tenant"]
    assert [r[3] for r in got] == [True, True, False]


@pytest.mark.parametrize("pattern,name,match", [("a.b*", "a.bc", True), ("a.b", "axb", False), ("*", "", True), ("a+*", "a+1", True)])
def test_topic_patterns(spark, pattern, name, match):
    assert spark.range(1).select(U.topic_matches(F.lit(name), pattern)).first()[0] is match


def test_evidence_summary(spark):
    df = spark.sql("SELECT map('b', '1', 'a', '', 'c', CAST(NULL AS STRING), 'A', 'x') AS e")
    assert df.select(U.evidence_summary(F.col("e"))).first()[0] == '{"A":"x","b":"1"}'


def test_uploads_without_hashes_are_decided(spark):
    rows = [
        (1, "a", None, 0, 10), (2, "a", None, 10, 20), (3, None, "b", 20, 30), (4, None, "b", 30, 40),
        (5, None, None, 35, 50), (6, None, None, 5, 50), (7, "c", "d", 50, 60), (8, "c", "e", 60, 70),
    ]
    log = spark.createDataFrame(
        [("t", "s", "e", a, start, end, b, c) for a, c, b, start, end in rows],
        "tenant_id string, source_id string, file_epoch string, arrival long, start_offset long, end_offset long, "
        "batch_hash string, content_hash string",
    )
    got = {r.arrival: (r.decision, r.reason) for r in dedupe_uploads(log).collect()}
    assert got == {
        1: ("forward", None), 2: ("drop_duplicate", "content_hash_match"), 3: ("forward", None),
        4: ("drop_duplicate", "batch_hash_match"), 5: ("forward", None), 6: ("drop_stale", None),
        7: ("forward", None), 8: ("drop_duplicate", "content_hash_match"),
    }
