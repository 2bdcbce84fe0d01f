import json
import pickle
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from simloom import storage
from simloom.sources import readers, sinks
from simloom.streaming import registry as streams


def test_pairs(spark, tmp_path):
    path = str(tmp_path / "pairs")
    df = spark.createDataFrame([("A.com", "b", 1.0), ("", "c", 0.0), ("D", "d", 0.0)], readers.PAIRS)
    sinks.parquet(df, path)
    with pytest.raises(ValueError):
        readers.pairs(spark, path)
    assert sorted(r.fraudulent_name for r in readers.pairs(spark, path, "lenient").collect()) == ["a", "d"]
    assert [r.label for r in readers.pairs(spark, path, "negatives").filter("fraudulent_name != ''").collect()] == [0.0]
    with pytest.raises(ValueError):
        readers.require_columns(df, ["nope"])


def test_rules(spark):
    df = spark.createDataFrame([("o", "0", "1.5"), ("o", "0", "2.5"), ("o", "o", "9"), ("ab", "c", "1"), ("l", "1", None)], "source string, replacement string, q string")
    got = {(r.source, r.replacement): r.score for r in readers.rules(df, F.col("q"), "ocr").collect()}
    assert got == {("o", "0"): 2.5, ("l", "1"): 0.0}
    swaps = spark.createDataFrame([("google", "gogole", 1.0), ("ab", "ba", 1.0)], "real_name string, swapped_name string, score double")
    assert [(r.swap_i, r.swap_j) for r in readers.swap_rules(swaps).collect()] == [(2, 3)]
    exact = spark.createDataFrame([("a", "а", 0.9995, 1.0), ("a", "ａ", 0.9995, 1.005), ("a", "b", 0.9, 1.0)], "source string, replacement string, glyph_similarity double, area_ratio double")
    assert {(r.replacement, r.priority) for r in readers.gated_exact(exact).collect()} == {("а", 0), ("ａ", 1)}
    names = spark.createDataFrame([("B.com", 1), ("b", 0), (".com", 2)], "name string, row_idx int")
    from simloom.functions.text import clean_anywhere

    assert [tuple(r) for r in readers.unique_names(names, clean_anywhere(F.col("name")), "row_idx").collect()] == [("b", 0, "b")]


def test_files(spark, tmp_path):
    p = tmp_path / "rows.pkl"
    p.write_bytes(pickle.dumps({"train": [("a", "b", 1.0)]}))
    assert readers.pickled_rows(spark, str(p), readers.PAIRS, "train").count() == 1
    j = tmp_path / "r.json"
    j.write_text(json.dumps([{"c": "U+1D5C5"}, {"c": "a"}]))
    assert sorted(r.c for r in readers.json_list(spark, str(j), "c string", ["c"]).collect()) == ["a", "\U0001d5c5"]
    made = readers.csv_or_derived(spark, str(tmp_path / "d.csv"), "x int", lambda: spark.range(3).select(F.col("id").cast("int").alias("x")))
    assert made.count() == 3 and readers.csv_or_derived(spark, str(tmp_path / "d.csv"), "x int", None).count() == 3
    sinks.manifest(spark, str(tmp_path / "m.json"), {"a": tmp_path, "n": 1})
    assert json.loads((tmp_path / "m.json").read_text())["n"] == 1
    assert readers.is_fresh(spark, str(tmp_path / "m.json"), [str(p)]) and readers.freshest(spark, ["/nowhere/x"]) is None
    assert readers.split_name("validate") == "validation" and readers.yaml_config(str(j))[1]["c"] == "a"
    with pytest.raises(ValueError):
        readers.split_name("x")
    df = readers.with_aliases(spark.range(1).select(F.col("id").alias("old")), {"new": ["old", "older"], "none": []})
    assert df.columns == ["new", "none"] and df.first().none is None
    assert "| a |" in sinks.markdown_table(spark.createDataFrame([("x|y",)], "a string"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0.7, 1), (0.2, 0)], "score double, label int")
    sinks.predictions(df, str(tmp_path / "p"))
    assert {(r.label, r.prediction_0_5) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, 1), (0, 0)}
    for _ in range(2):
        sinks.append(df, str(tmp_path / "log"))
    assert readers.typed_csv(spark, str(tmp_path / "log"), "score double, label int").count() == 4
    sinks.two_sections(spark, str(tmp_path / "two"), df, df)
    sinks.review_table(df, str(tmp_path / "review"), {"review_state": "open"})
    assert spark.read.parquet(str(tmp_path / "review")).filter("review_state = 'open'").count() == 2
    sinks.split_files(spark.createDataFrame([("train", None, "b", 1.0)], "split string, fraudulent_name string, real_name string, label double"), str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.parquet(df, str(tmp_path / "p"), replace=False)


def test_upsert_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "key string, at int, v double"
    for k, rows in enumerate([[("a", 1, 0.1), ("b", 1, 0.2)], [("a", 2, 0.3)], [("b", 0, 0.9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append" if k else "overwrite").parquet(src)
    q = streams.upsert_stream(streams.parquet_stream(spark, src), out, ["key"], "at", str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 2, 0.3), ("b", 1, 0.2)]


def test_stream_operators(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:10:00", 2.0), ("a", "2024-01-01 05:00:00", 3.0), ("b", "2024-01-01 00:00:00", 1.0)]
    spark.createDataFrame(rows, "key string, t string, value double").select("key", F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.parquet(src)
    for name, df, want in (
        ("first", streams.first_seen(streams.parquet_stream(spark, src), ["key"], "ts", "10 hours"), 2),
        ("sess", streams.sessions(streams.parquet_stream(spark, src), "ts", ["key"], "30 minutes"), 3),
        ("slide", streams.windowed_counts(streams.parquet_stream(spark, src), "ts", ["key"], "1 hour", "30 minutes"), 6),
    ):
        q = df.writeStream.outputMode("append" if name == "first" else "complete").format("memory").queryName(f"t_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"t_{name}").count() == want, name


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with storage.scratch(spark) as outer:
        with storage.scratch(spark) as inner:
            gone = storage.materialize(spark.range(3).toDF("x"), "gone")
            stays = inner.keep(gone, "stays")
            assert gone.count() == 3
        assert stays.count() == 3
        with pytest.raises(Exception, match="(?i)not exist|not found"):
            gone.collect()
        last = outer.keep(stays, "last")
    assert last.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        stays.collect()


def test_shared_folder():
    def session(setting, context, master="yarn"):
        own = SimpleNamespace(getCheckpointDir=lambda: context, master=master)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=own)

    assert storage.shared_dir(session("hdfs:/named/", "hdfs:/context")) == "hdfs:/named"
    assert storage.shared_dir(session(None, "hdfs:/context/")) == "hdfs:/context"
    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_dir(session(None, None))


def test_run_names_config_copies_and_console_tables(spark, tmp_path):
    assert readers.config_run_name({"run_name": "a"}) == "a" and len(readers.config_run_name({})) == 16
    sinks.config(spark, str(tmp_path / "config.yaml"), {"z": 1, "a": [0.5, None]})
    assert readers.yaml_config(str(tmp_path / "config.yaml")) == {"z": 1, "a": [0.5, None]}
    shown = sinks.console_table(spark.createDataFrame([("a", 1234, 0.5), ("long name", None, 12.0)], "name string, n int, score double"))
    assert shown.split("\n") == ["name           n    score", "---------  -----  -------", "a          1,234   0.5000", "long name      -  12.0000"]
