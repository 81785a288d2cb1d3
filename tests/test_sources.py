import json

import pytest
from pyspark.sql import functions as F

from facetlens.operators import grid
from facetlens.sources import tables as S
from facetlens.streaming import incremental as I


def test_prompt_metadata_checks(spark, tmp_path):
    head = ",".join(S.PROMPT_REQUIRED)
    good = tmp_path / "good.csv"
    good.write_text(head + "\np1,t1,f,form,e,ax,,NA\n")
    r = S.read_prompt_metadata(spark, str(good)).first()
    assert r["canonical_label"] == "" and r["prompt"] == "NA"
    blank = tmp_path / "blank.csv"
    blank.write_text(head + "\np1,t1,f,form,e,ax,L,  \n")
    with pytest.raises(ValueError, match="blank"):
        S.read_prompt_metadata(spark, str(blank))
    short = tmp_path / "short.csv"
    short.write_text("prompt_id,prompt\np1,x\n")
    with pytest.raises(ValueError, match="lacks"):
        S.read_prompt_metadata(spark, str(short))


def test_vectors_must_align(spark):
    vec = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0])], "layer int, row_id long, vec array<double>")
    meta = spark.createDataFrame([(0,), (1,)], "row_id long")
    assert S.read_vectors_aligned(vec, meta, [1]).count() == 2
    with pytest.raises(ValueError):
        S.read_vectors_aligned(vec, meta, [1, 2])
    with pytest.raises(ValueError):
        S.read_vectors_aligned(vec, meta.filter("row_id = 0"), [1])


def test_items_jsonl_by_category(spark, tmp_path):
    for name in ("Race_ethnicity", "Age"):
        rows = [{"example_id": i, "category": name, "additional_metadata": {"stereotyped_groups": ["Black"]}, "answer_info": {"ans0": ["t", "g"]}} for i in range(3)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    got = S.read_items_jsonl(spark, str(tmp_path), ["race ethnicity"]).collect()
    assert len(got) == 3 and {r["source_file"] for r in got} == {"Race_ethnicity.jsonl"}
    assert got[0]["additional_metadata"]["stereotyped_groups"] == ["Black"] and got[0]["answer_info"]["ans0"] == ["t", "g"]
    assert S.read_items_jsonl(spark, str(tmp_path)).count() == 6


def test_result_parts_and_writer(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_result_parts(spark, str(tmp_path), spark.range(1).schema)
    spark.range(3).write.parquet(str(tmp_path / "part_00000.parquet"))
    spark.range(2).write.option("header", True).csv(str(tmp_path / "part_00001.csv"))
    assert S.read_result_parts(spark, str(tmp_path), spark.range(1).schema).count() == 5
    df = spark.range(4).withColumn("x", F.lit(1))
    S.write_table(df, str(tmp_path / "t"), ["id"], csv=True)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        S.write_table(df, str(tmp_path / "t"), ["id"])
    S.write_table(df, str(tmp_path / "t"), ["id"], mode="overwrite")
    assert spark.read.parquet(str(tmp_path / "t.parquet")).columns == ["id"]


def test_conform(spark):
    df = spark.createDataFrame([("3", "x", "nan"), ("4", "0.5", "1e3")], "feature string, score string, auc string")
    got = S.conform_columns(df).collect()
    assert [r["feature_id"] for r in got] == [3.0, 4.0]
    assert [r["combined_score"] for r in got] == [None, 0.5] and [r["auc"] for r in got] == [None, 1000.0]


def test_grid_rejects_unknown_form(spark):
    t = spark.createDataFrame([("t", "f", "x {form}", "nope", "", "")], "template_id string, family string, template_text string, required_form string, number string, notes string")
    forms = spark.createDataFrame([("e", "a", "l", "n", "adj")], "entity string, axis string, canonical_label string, entity_notes string, adj_form string")
    with pytest.raises(ValueError, match="nope"):
        grid.prompt_grid(t, forms, ["adj_form"])


def test_incremental(spark, tmp_path):
    log = tmp_path / "done.jsonl"
    log.write_text('{"job_id": "a"}\nbroken\n{"other": 1}\n{"job_id": "a"}\n{"job_id": "b"}\n')
    assert {r["job_id"] for r in I.completed_jobs(spark, str(log)).collect()} == {"a", "b"}
    done = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "prompt string, f int")
    assert [r["prompt"] for r in I.fully_processed(done, "prompt", "f", 2).collect()] == ["p"]
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.range(3).write.parquet(src)
    for _ in range(2):
        I.ingest_new_parts(spark, src, spark.range(1).schema, out, cp)
    spark.range(2).write.mode("append").parquet(src)
    I.ingest_new_parts(spark, src, spark.range(1).schema, out, cp)
    assert spark.read.parquet(out).count() == 5


def test_raw_items_of_any_shape(spark, tmp_path):
    import json

    from facetlens.sources.tables import read_raw_items

    whole = {
        "example_id": 7, "question_index": "2", "category": "SES", "context_condition": "ambig", "question_polarity": "neg", "context": "c", "question": "q", "ans0": "x", "ans1": "y", "ans2": "z", "label": 1,
        "answer_info": {"ans0": ["The x", "poor"], "ans1": ["The y", "rich"], "ans2": ["Unknown", "unknown"]}, "additional_metadata": {"subcategory": "s", "stereotyped_groups": ["poor", None]},
    }
    lines = [
        json.dumps(whole), json.dumps({"answer_info": {"ans0": ["only text"], "ans1": "no list", "ans2": []}, "label": "two", "additional_metadata": None, "more": {"deep": [1]}}),
        json.dumps({"example_id": "id", "answer_info": [], "additional_metadata": {"stereotyped_groups": "poor"}, "label": 2.0}), "{}", "", "   ", "[]", "3", "null", '{"a":', "no json",
    ]
    (tmp_path / "Age.jsonl").write_text("\n".join(lines))
    (tmp_path / "Race_ethnicity.jsonl").write_text(json.dumps(whole))
    items, bad = read_raw_items(spark, str(tmp_path))
    got = [r for r in items.collect() if r["source_file"] == "Age.jsonl"]
    assert len(got) == 4 and items.count() == 5 and sorted(r["line"] for r in bad.collect()) == sorted(lines[6:])
    one = next(r for r in got if r["example_id"] == "7")
    assert one["item_uid"] == "Age:7:2:ambig:neg:Age.jsonl" and one["category_raw"] == "SES" and one["correct_answer_idx"] == 1
    assert one["answer_labels"] == ["poor", "rich", "unknown"] and one["stereotyped_groups"] == ["poor"] and one["subcategory"] == "s"
    bare = next(r for r in got if r["answer_texts"][0] == "only text")
    assert bare["answer_labels"] == ["only text", "", ""] and bare["category_raw"] == "Age" and bare["stereotyped_groups"] == [] and bare["correct_answer_idx"] is None
    odd = next(r for r in got if r["example_id"] == "id")
    assert odd["answer_texts"] == ["", "", ""] and odd["context"] == "" and len({r["item_uid"] for r in got}) == 4
    chosen, _ = read_raw_items(spark, str(tmp_path), ["race ethnicity"])
    assert [r["source_file"] for r in chosen.collect()] == ["Race_ethnicity.jsonl"]


def test_csv_records_over_many_byte_ranges(spark, tmp_path):
    import csv
    import random

    from facetlens.sources.records import csv_records, read_csv_ranges

    draw = random.Random(4)
    rows = [[str(k), "".join(draw.choice(['a', 'é', ',', '"', "\n", " ", "\r\n", '""', "b,\n\n"]) for _ in range(draw.choice([0, 3, 30, 400 if k % 40 else 6000]))), draw.choice(["x", " y ", ""])] for k in range(400)]
    for name, end, part in (("one.csv", "\n", rows[:300]), ("two.csv", "\r\n", rows[300:])):
        with open(tmp_path / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "the text", "last"])
            w.writerows(part)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        # Ranges shorter than the longest records, and several ranges of two files in a task.
        for size, cost in (("2000", "0"), ("50000", "10"), ("134217728", "4194304")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            got = {r["id"]: tuple(r) for r in read_csv_ranges(spark, str(tmp_path)).na.fill("").collect()}
            assert len(got) == 400
            for r in rows:
                assert got[r[0]] == tuple(r), (size, r)
            assert csv_records(spark, str(tmp_path)).filter("first").count() == 2
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        assert read_csv_ranges(spark, str(tmp_path / "one.csv")).rdd.getNumPartitions() > 20
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "none.csv").write_text("")
    with pytest.raises(ValueError):
        read_csv_ranges(spark, str(tmp_path / "empty"))
