"""The narrow operators on streaming tables: newly arrived files and responses."""

from codesift.operators import findings, responses, rules


def drain(frame, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return frame.sparkSession.table(name)


def test_scan_of_arriving_files(spark, files, tmp_path):
    rows = files([("r", "a.py", 'password = "x"\n'), ("r", "b.py", "y")])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = drain(findings.from_hits(rules.scan(stream)), "stream_hits").collect()
    assert [(r.file_path, r.line_number) for r in found] == [("a.py", 1)]


def test_parsing_of_arriving_responses(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a.py", "analysis", '[{"severity":"high"}]')], "repo_id string, rel_path string, kind string, response string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = drain(responses.parse_responses(stream), "stream_findings").collect()
    assert [(r.severity, r.confidence) for r in found] == [("high", 0.8)]
