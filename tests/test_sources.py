import json

import pytest
from pyspark.sql import functions as F

from flowsentry.operators.clean import clean_flows
from flowsentry.plans.alerts import append_alerts, build_alerts, tenant_alerts
from flowsentry.sources import flow_csv, reports, signature_files, topics
from flowsentry.sources.packets import read_packets


def _flows(tmp_path):
    root = tmp_path / "flows"
    (root / "b").mkdir(parents=True)
    (root / "A.csv").write_text(
        "Flow ID, Source IP, Destination Port, Flow Bytes/s, Fwd Header Length, Fwd Header Length, Label\n"
        "x,1.1.1.1,80,Infinity,4,5,BENIGN\n"
        "y,1.1.1.2,443,NaN,6,7,DDoS\n"
    )
    (root / "b" / "C.CSV").write_bytes(
        "Src IP,Dst Port,Tot Fwd Pkts,Label\n2.2.2.2,22,12,Web Attack – XSS\n2.2.2.3,bad,1,BENIGN\n".encode("cp1252")
    )
    (root / "notes.txt").write_text("not a flow file")
    return root


def test_flow_folder(spark, tmp_path):
    df = flow_csv.read_flow_folder(spark, str(_flows(tmp_path)))
    rows = {r["row_id"]: r for r in df.collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert [rows[i]["source_file"] for i in range(4)] == ["A.csv", "A.csv", "C.CSV", "C.CSV"]
    assert rows[0]["flow_bytes_s"] == float("inf") and rows[0]["Fwd Header Length.1"] == 5.0
    assert rows[2]["source_ip"] == "2.2.2.2" and rows[2]["flow_bytes_s"] is None
    assert rows[3]["destination_port"] is None and rows[3]["total_fwd_packets"] == 1.0
    cleaned = {r["row_id"]: r["multiclass_label"] for r in clean_flows(df, 0.8).collect()}
    assert cleaned[2] == "Web Attack - XSS" and cleaned[1] == "DDoS"
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        flow_csv.read_flow_folder(spark, str(tmp_path / "empty"))


def test_row_ids_follow_file_order_over_many_blocks(spark, tmp_path):
    root = tmp_path / "many"
    root.mkdir()
    n = 0
    for name in ("a", "b", "c"):
        lines = ["Flow Duration,Label"] + [f"{n + i},BENIGN" for i in range(3000)]
        (root / f"{name}.csv").write_text("\n".join(lines) + "\n")
        n += 3000
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = flow_csv.read_flow_folder(spark, str(root), check_encoding=False)
        assert df.rdd.getNumPartitions() > 3
        assert df.filter(F.col("flow_duration") != F.col("row_id")).count() == 0
        assert df.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_diagnostics_show_absent_files(spark, tmp_path):
    root = _flows(tmp_path)
    df = flow_csv.read_flow_folder(spark, str(root))
    wanted = spark.createDataFrame([("A.csv",), ("zzz.csv",)], "source_file string")
    got = {r["source_file"]: r for r in flow_csv.file_diagnostics(spark, wanted, str(root), df).collect()}
    assert got["A.csv"]["input_file_exists"] and got["A.csv"]["raw_rows_loaded"] == 2
    assert got["A.csv"]["input_file_size_bytes"] == (root / "A.csv").stat().st_size
    assert not got["zzz.csv"]["input_file_exists"] and got["zzz.csv"]["raw_rows_loaded"] == 0


def test_alert_folder_policy_and_split_ids(spark, tmp_path):
    day = tmp_path / "snort" / "Monday-WorkingHours"
    day.mkdir(parents=True)
    (day / "alert_fast.txt").write_text('07/03-18:55:58.5 [**] [1:491:1] "m" [**] [Priority: 1] {TCP} 1.1.1.1:2 -> 3.3.3.3:4\nx\n')
    (day / "other.txt").write_text("ignored")
    row = signature_files.read_alert_folder(spark, str(tmp_path / "snort")).first()
    assert (row["pcap_name"], row["sid"], row["dst_port"]) == ("Monday-WorkingHours", 491, 4)
    assert row["source_file"].endswith("alert_fast.txt")
    good, junk, empty = (tmp_path / n for n in ("good", "junk", "empty"))
    good.write_text("# keep\n\n491\n 553 \n491\n")
    junk.write_text("491\nabc\n")
    empty.write_text("# nothing\n")
    assert sorted(r["sid"] for r in signature_files.read_policy(spark, str(good)).collect()) == [491, 553]
    for bad in (junk, empty):
        with pytest.raises(ValueError):
            signature_files.read_policy(spark, str(bad))
    ids = tmp_path / "ids.json"
    ids.write_text(json.dumps({"train": [9], "my_Test_rows": [1, 2], "test_ids": [3, 4]}))
    assert sorted(r[0] for r in signature_files.read_split_ids(spark, str(ids)).collect()) == [3, 4]
    ids.write_text(json.dumps({"train": [9], "my_Test_rows": [1, 2]}))
    assert sorted(r[0] for r in signature_files.read_split_ids(spark, str(ids)).collect()) == [1, 2]
    ids.write_text(json.dumps({"train": [9]}))
    with pytest.raises(ValueError):
        signature_files.read_split_ids(spark, str(ids))


def test_topics(spark, tmp_path):
    values = ['{"tenant_id": "a", "file_path": "p", "start_offset": 5}', "[1]", "nope", "", None, '"text"', '{"decision": null}']
    records = spark.createDataFrame([("raw.tenant.a", 0, i, v) for i, v in enumerate(values)], "topic string, partition int, offset long, value string")
    assert [tuple(r)[1:] for r in topics.consumed(records).orderBy("offset").collect()] == [(0, "a", "", "p", ""), (6, "", "", "", "")]
    assert topics.malformed(records).count() == 5
    parsed = {r["offset"]: r for r in topics.parse_events(records).collect()}
    assert parsed[0]["start_offset"] == 5 and parsed[2]["tenant_id"] is None and len(parsed[0]) == 16
    out = topics.to_records(spark.createDataFrame([("t1", 1)], "tenant string, v int"), F.concat(F.lit("alert.tenant."), "tenant"))
    topics.publish(out, folder=str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back["topic"] == "alert.tenant.t1" and json.loads(back["value"]) == {"tenant": "t1", "v": 1}
    with pytest.raises(ValueError):
        topics.publish(out)


def test_alert_store(spark, tmp_path):
    judged = spark.createDataFrame(
        [("t1", "s", "d/x.pcap", "attack"), ("", None, None, "attack"), ("t2", "s", "y", "benign"), ("t2", "s", "y", "error")],
        "tenant_id string, source_id string, file_path string, prediction string",
    ).select(
        "*",
        *[F.lit(None).cast("string").alias(c) for c in ("file_type", "original_filename", "batch_hash", "content_hash", "decision", "topic", "offset", "severity", "attack_type", "stage")],
        F.create_map(F.lit("file_name"), F.lit("old"), F.lit("why"), F.lit("rule")).alias("evidence"),
    )
    alerts = build_alerts(judged)
    path = str(tmp_path / "store")
    append_alerts(alerts, path)
    append_alerts(build_alerts(judged).filter("tenant_id = 't1'"), path)
    rows = tenant_alerts(spark, path, "t1").collect()
    assert len(rows) == 2 and len({r["alert_id"] for r in rows}) == 2
    assert rows[0]["evidence"]["file_name"] == "x.pcap" and rows[0]["evidence"]["why"] == "rule"
    other = tenant_alerts(spark, path, "unknown_tenant").first()
    assert (other["source_id"], other["severity"], other["evidence"]["file_type"]) == ("unknown_source", "high", "pcap")


def test_packets_and_reports(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        '"frame.time_epoch","ip.src","ip.dst","ip.proto","tcp.srcport","tcp.dstport","udp.srcport","udp.dstport","frame.len","tcp.flags.syn","tcp.flags.ack"\n'
        '"1.5","a","b","6","1","2","","","60","True","False"\n'
    )
    row = read_packets(spark, str(tmp_path / "p.csv")).first()
    assert row["frame.time_epoch"] == "1.5" and row["capture"] == "p.csv"
    df = spark.createDataFrame([(1, "val", 0), (2, "test", 1)], "row_id long, split string, binary_label int")
    reports.write_predictions(df, str(tmp_path / "pred"))
    assert spark.read.parquet(str(tmp_path / "pred")).filter("split = 'test'").count() == 1
    reports.write_report(df, str(tmp_path / "rep"))
    assert len(list((tmp_path / "rep").glob("*.csv"))) == 1
    reports.write_summary(reports.run_summary(df, {"seed": 1}), str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).first()["n_test"] == 1
