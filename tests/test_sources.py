import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.operators import gates as G
from sievework.sources import adapters as AD
from sievework.sources import io as IO
from sievework.sources import options as OP


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id":"a","n":1}\n\n  {"id":"b"}  \n{"id":"ü","n":3}\n')
    got = IO.json_lines(spark, str(p), "id string, n int").orderBy("_pos").collect()
    assert [(r.id, r.n) for r in got] == [("a", 1), ("b", None), ("ü", 3)]
    p.write_text('{"id":"a"}\n[1]\n')
    with pytest.raises(Exception, match="no JSON object at"):
        IO.json_lines(spark, str(p), "id string", strict=True).collect()
    out = str(tmp_path / "out")
    IO.write_json_lines(spark.createDataFrame([("ü", None)], "id string, n int"), out)
    assert [json.loads(r.value) for r in spark.read.text(out).collect()] == [{"id": "ü", "n": None}]
    IO.write_json_lines(spark.createDataFrame([("v", 1)], "id string, n int"), out, append=True)
    assert spark.read.text(out).count() == 2


def test_token_folder_and_dispatch(spark, tmp_path):
    for k in ("p1", "p2"):
        (tmp_path / "tokens" / k).mkdir(parents=True)
        (tmp_path / "tokens" / k / "synthetic.json").write_text(json.dumps({"tokens": [1, 2], "mask": [0, 1]}))
    got = IO.evaluation_rows(spark, str(tmp_path), "x string")
    assert {(r.problem_id, tuple(r.tokens), tuple(r.mask)) for r in got.collect()} == {("p1", (1, 2), (0.0, 1.0)), ("p2", (1, 2), (0.0, 1.0))}
    IO.write_tokens(got.withColumn("category", F.lit("c")), str(tmp_path / "t"), "category")
    assert spark.read.parquet(str(tmp_path / "t/index")).agg(F.sum("num_loss_tokens")).first()[0] == 2


def test_csv_and_maps(spark, tmp_path):
    df = spark.createDataFrame([("a", None, [1, 2])], "id string, v string, t array<int>")
    IO.write_csv(df, str(tmp_path / "c"), ["id", "v", "t", "extra"])
    r = IO.text_csv(spark, str(tmp_path / "c")).first()
    assert (r.id, r.t, r.v or "", r.extra or "") == ("a", "[1,2]", "", "")
    (tmp_path / "m.json").write_text('{"x": "bit", "y": 2}')
    assert {(r.key, r.value) for r in IO.json_map(spark, str(tmp_path / "m.json")).collect()} == {("x", "bit"), ("y", "2")}


def test_tokenized_rows(spark):
    df = spark.createDataFrame([("a b", "c", None), (None, None, "d e f")], "p string, r string, t string")
    got = IO.tokenized(df, "p", "r", "t").collect()
    assert [list(r["mask"]) for r in got] == [[0, 0, 1, 1], [1, 1, 1, 1]]
    with pytest.raises(Exception, match="neither prompt"):
        IO.tokenized(spark.createDataFrame([(None, None, None)], "p string, r string, t string"), "p", "r", "t").collect()


def test_kept(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "k")
    assert IO.kept(spark, path, build).count() == 3 and IO.kept(spark, path, build).count() == 3 and len(calls) == 1
    IO.kept(spark, path, build, rebuild=True)
    assert len(calls) == 2


def archive(rank=32, drop=None):
    header = {"__metadata__": {}, "m.lora_A.weight": {"dtype": "F32", "shape": [rank, 4], "data_offsets": [0, 8]}, "m.lora_B.weight": {"dtype": "F32", "shape": [4, 32], "data_offsets": [8, 16]}}
    raw = json.dumps(header).encode()
    files = {"adapter_config.json": json.dumps({"r": 32, "lora_alpha": 32, "lora_dropout": 0.0, "target_modules": list(G.MODULES)}).encode(), "adapter_model.safetensors": len(raw).to_bytes(8, "little") + raw + bytes(16)}
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            if k != drop:
                z.writestr(k, v)
    return b.getvalue(), files


def test_archives(spark, tmp_path):
    good, files = archive()
    assert AD.archive_findings(good) == []
    assert AD.archive_findings(archive(rank=8)[0]) == ["m.lora_A.weight has shape [8, 4]"]
    assert AD.archive_findings(archive(drop="adapter_config.json")[0]) == ["missing adapter_config.json"]
    assert AD.archive_findings(b"junk") == ["no zip archive"]
    (tmp_path / "a.zip").write_bytes(good)
    (tmp_path / "b.zip").write_bytes(b"junk")
    assert {(r.path.rsplit("/", 1)[1], r.member) for r in AD.members(spark, str(tmp_path / "*.zip")).collect()} == {("a.zip", "adapter_config.json"), ("a.zip", "adapter_model.safetensors"), ("b.zip", None)}
    d = tmp_path / "deep" / "x"
    d.mkdir(parents=True)
    for k, v in files.items():
        (d / k).write_bytes(v)
    assert {(r.name, tuple(r.shape)) for r in AD.headers(spark, str(d / "*.safetensors")).collect()} == {("m.lora_A.weight", (32, 4)), ("m.lora_B.weight", (4, 32))}
    assert AD.adapter_folder(str(tmp_path / "deep")) == str(d) and AD.adapter_folder(str(tmp_path / "none")) is None
    assert AD.pack(str(d), str(tmp_path / "o.zip")) == ["adapter_config.json", "adapter_model.safetensors"]
    assert IO.provenance(spark, str(d)).count() == 2


def test_written_tensors_are_read_back(spark, tmp_path):
    AD.write_tensors({"x.lora_A.default.weight": [[1.0, 2.0, 3.0]], "x.lora_B.default.weight": [[1.0], [2.0]]}, str(tmp_path / "a.safetensors"))
    got = {r.name: (tuple(r.shape), tuple(r.offsets)) for r in AD.headers(spark, str(tmp_path / "a.safetensors")).collect()}
    assert got == {"x.lora_A.weight": ((1, 3), (0, 12)), "x.lora_B.weight": ((2, 1), (12, 20))}


def test_names_of_tensors(one):
    assert one(AD.plain_key(F.col("a")), "base_model.model.backbone.x.lora_A.default.weight") == "base_model.model.model.x.lora_A.weight"
    for name, want in (("lm_head", "lm_head"), ("a.self_attn.q_proj", "attention"), ("a.mamba.in_proj", "mamba_or_ssm"), ("a.experts.0.up_proj", "moe_or_expert"), ("a.mlp.up_proj", "ffn_or_mlp"), ("embed_tokens", "embedding"), ("norm", "other_linear")):
        assert one(AD.module_kind(F.col("a")), name) == want


def test_options():
    assert OP.flag("Yes") is True and OP.flag("0") is False
    assert OP.names(" a, ,b ") == ["a", "b"] and OP.numbers("0.1,2") == [0.1, 2.0] and OP.scales("a=1,b.c=0.5") == [("a", 1.0), ("b.c", 0.5)]
    assert OP.folder_of(0.05) == "lambda_0p05"
    for bad in ("maybe",):
        with pytest.raises(ValueError):
            OP.flag(bad)
    with pytest.raises(ValueError, match="no name=value"):
        OP.scales("a")


def test_live_results(spark, tmp_path):
    from sievework.streaming.live import live

    rows = [(i, str(i), f"\\boxed{{{i if i % 2 else 99}}}") for i in range(6)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, "idx int, answer string, raw_output string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("idx int, answer string, raw_output string").parquet(src)
        live(stream, out, str(tmp_path / "ck")).awaitTermination()
    last = spark.read.parquet(f"{out}/running").orderBy(F.desc("batch")).first()
    assert (last.seen, last.correct, last.accuracy) == (6, 3, 0.5)
    assert spark.read.text(f"{out}/rows").count() == 6
