"""Adapter archives: members, tensor headers, contract checks, names of modules and tensors."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.gates import ADAPTER, MODULES

# Words in module names that tell their kind, in order of precedence.
ATTENTION_LEAVES = ("q_proj", "k_proj", "v_proj", "o_proj", "query", "key", "value", "query_key_value", "dense")
ATTENTION_WORDS = ("self_attn", "attention", "attn")
MIXER_WORDS, MIXER_LEAVES = ("mamba", "ssm", "mixer", "conv1d", "selective"), ("in_proj", "out_proj", "x_proj", "dt_proj", "conv1d", "conv_proj")
EXPERT_WORDS = ("expert", "moe", "router")
FEED_LEAVES, FEED_WORDS = ("up_proj", "down_proj", "gate_proj", "gate_up_proj", "w1", "w2", "w3", "fc1", "fc2"), ("mlp", "feed_forward", "ffn")


def leaf(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def module_kind(name: Column) -> Column:
    """lm_head, attention, mamba_or_ssm, moe_or_expert, ffn_or_mlp, embedding or other_linear; null for null."""
    low, end = F.lower(name), F.lower(leaf(name))
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    return (
        F.when(name.isNull(), None)
        .when((end == "lm_head") | low.endswith(".lm_head"), "lm_head")
        .when(end.isin(*ATTENTION_LEAVES) | (has(low, ATTENTION_WORDS) & end.contains("proj")), "attention")
        .when(has(low, MIXER_WORDS) | end.isin(*MIXER_LEAVES), "mamba_or_ssm")
        .when(has(low, EXPERT_WORDS), "moe_or_expert")
        .when(end.isin(*FEED_LEAVES) | has(low, FEED_WORDS), "ffn_or_mlp")
        .when(low.contains("embed"), "embedding")
        .otherwise("other_linear")
    )


def tunable(kind: Column, end: Column) -> Column:
    return (kind != "embedding") & ~end.isin("", "weight")


def shape_text(shape: Column) -> Column:
    return F.array_join(F.transform(shape, lambda x: x.cast("string")), "x")


def plain_key(key: Column) -> Column:
    """A tensor's name without the adapter's own name and the wrapper's namespace."""
    key = F.replace(key, F.lit("base_model.model.backbone."), F.lit("base_model.model.model."))
    return F.regexp_replace(key, r"\.lora_([AB])\.(?:residual|default)\.weight", ".lora_$1.weight")


def scale(alpha: Column, rank: Column) -> Column:
    return alpha / F.greatest(rank, F.lit(1))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape, offsets) of safetensors files: an 8-byte little-endian length, then a JSON object."""
    b = spark.read.format("binaryFile").load(path).select("path", "content")
    n = F.expr("cast(conv(concat(hex(substring(content,8,1)),hex(substring(content,7,1)),hex(substring(content,6,1)),hex(substring(content,5,1)),hex(substring(content,4,1)),hex(substring(content,3,1)),hex(substring(content,2,1)),hex(substring(content,1,1))),16,10) as int)")
    text = F.decode(F.substring(F.col("content"), F.lit(9), n), "UTF-8")
    e = b.select("path", F.explode(F.from_json(text, "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>")).alias("name", "t"))
    return e.where("name <> '__metadata__'").select("path", "name", "t.dtype", "t.shape", F.col("t.data_offsets").alias("offsets"))


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, bytes, content) of zip archives; a broken archive gives one row with null member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(c)) as z:
                        out += [(p, i.filename, i.file_size, z.read(i)) for i in sorted(z.infolist(), key=lambda i: i.filename) if not i.is_dir()]
                except zipfile.BadZipFile:
                    out.append((p, None, None, None))
            yield pd.DataFrame(out, columns=["path", "member", "bytes", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, bytes long, content binary")


def archive_findings(data: bytes, expected: Mapping[str, float] = ADAPTER, modules: Sequence[str] = MODULES) -> list[str]:
    """What is wrong with an adapter archive: members, settings, tensor header, ranks of the factors."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return ["no zip archive"]
    with z:
        lack = [n for n in ("adapter_config.json", "adapter_model.safetensors") if n not in z.namelist()]
        if lack:
            return [f"missing {n}" for n in lack]
        config, raw = json.loads(z.read("adapter_config.json")), z.read("adapter_model.safetensors")
    found = [f"{k} is {config.get(k)}, not {v}" for k, v in expected.items() if config.get(k) != v]
    if set(map(str, config.get("target_modules", ()))) != set(modules):
        found.append("other target modules")
    size = int.from_bytes(raw[:8], "little")
    if len(raw) < 8 or size <= 0 or 8 + size > len(raw):
        return [*found, "bad tensor header"]
    shapes = {k: v.get("shape") for k, v in json.loads(raw[8 : 8 + size]).items() if k != "__metadata__"}
    sides = {s: {k: v for k, v in shapes.items() if f".lora_{s}." in k and k.endswith(".weight")} for s in "AB"}
    for s, axis in (("A", 0), ("B", 1)):
        found += [f"{k} has shape {v}" for k, v in sorted(sides[s].items()) if not isinstance(v, list) or len(v) != 2 or v[axis] != expected["r"]]
    if not sides["A"] or len(sides["A"]) != len(sides["B"]):
        found.append("numbers of A and B tensors differ or are 0")
    return found


def pack(folder: str, out: str, suffixes: Sequence[str] = (".json", ".safetensors", ".model", ".txt")) -> list[str]:
    """Zips the folder's files of the given kinds in sorted order; returns their relative paths."""
    root = Path(folder)
    names = sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file() and p.suffix in suffixes)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(root / n, n)
    return names


def adapter_folder(root: str, weights: bool = True) -> str | None:
    """The folder itself if it holds an adapter, else the first below it in sorted order, else None."""
    ok = lambda p: (p / "adapter_config.json").is_file() and (not weights or (p / "adapter_model.safetensors").is_file())
    base = Path(root)
    if ok(base):
        return str(base)
    return next((str(p.parent) for p in sorted(base.rglob("adapter_config.json")) if ok(p.parent)), None)


def write_tensors(tensors: Mapping[str, Sequence[Sequence[float]]], path: str) -> None:
    """A safetensors file of float32 matrices, their names made plain: the 8-byte length, the JSON header, the data."""
    import re
    import struct

    header, data = {}, b""
    for name, rows in sorted(tensors.items()):
        raw = b"".join(struct.pack(f"<{len(r)}f", *r) for r in rows)
        key = re.sub(r"\.lora_([AB])\.(?:residual|default)\.weight", r".lora_\1.weight", name)
        header[key] = {"dtype": "F32", "shape": [len(rows), len(rows[0]) if rows else 0], "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    text = json.dumps(header).encode()
    Path(path).write_bytes(len(text).to_bytes(8, "little") + text + data)
