"""Readers that choose among paths, and records as one array."""

import json
import tempfile

import pytest

from varaka.sources import io


def test_the_first_path_that_exists_is_read(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    labels = {"document_type": "A", "key_information": [], "missing_information": []}
    with open(f"{folder}/b.jsonl", "w") as f:
        f.write(json.dumps({"document_text": "x", "labels": labels}) + "\n\n" + json.dumps({"messages": [{"role": "system", "content": ""}, {"role": "user", "content": "y"}, {"role": "assistant", "content": json.dumps(labels)}]}) + "\n")
    rows = io.read_eval_records(spark, f"{folder}/a.jsonl", f"{folder}/b.jsonl", f"{folder}/c.jsonl").collect()
    assert sorted((r["document_text"], r["labels"]["document_type"]) for r in rows) == [("x", "A"), ("y", "A")]
    with pytest.raises(FileNotFoundError):
        io.read_eval_records(spark, f"{folder}/a.jsonl")


def test_records_as_lines_and_as_one_array(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([(k, "ş\"") for k in range(5)], "id int, text string").repartition(3)
    io.write_records(df, f"{folder}/lines")
    io.write_records(df, f"{folder}/array", array=True)
    assert spark.read.json(f"{folder}/lines").count() == 5
    whole = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/array").collect()))
    assert sorted(x["id"] for x in whole) == list(range(5)) and whole[0]["text"] == 'ş"'
