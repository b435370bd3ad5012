"""Embedding providers and counters."""

import numpy as np
import pytest
from tokenizers import Tokenizer
from tokenizers.models import WordLevel
from tokenizers.pre_tokenizers import WhitespaceSplit

from siltstone.functions import half_pack
from siltstone.operators import embed

WORDS = {"[PAD]": 0, "[UNK]": 1, "red": 2, "green": 3, "blue": 4}
TABLE = np.random.default_rng(8).normal(0, 1, (5, 6)).astype(np.float32)


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(*fields):
    """A protocol buffer of (number, int or bytes or str) fields."""
    out = b""
    for number, v in fields:
        if isinstance(v, int):
            out += _varint(number << 3) + _varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += _varint(number << 3 | 2) + _varint(len(v)) + v
    return out


def _model():
    """A sentence model of two nodes: a table look-up, and an identity."""

    def value(name, kind, dims):
        shape = _message(*((1, _message((2, d))) for d in dims))
        return _message((1, name), (2, _message((1, _message((1, kind), (2, shape))))))

    table = _message((1, TABLE.shape[0]), (1, TABLE.shape[1]), (2, 1), (8, "table"), (9, TABLE.tobytes()))
    nodes = [_message((1, "table"), (1, "input_ids"), (2, "looked"), (4, "Gather")), _message((1, "looked"), (2, "last_hidden_state"), (4, "Identity"))]
    graph = _message(*((1, n) for n in nodes), (2, "g"), (5, table), (11, value("input_ids", 7, "bs")), (12, value("last_hidden_state", 1, "bsd")))
    return _message((1, 8), (7, graph), (8, _message((1, ""), (2, 17))))


@pytest.fixture
def provider(tmp_path):
    tok = Tokenizer(WordLevel(WORDS, unk_token="[UNK]"))
    tok.pre_tokenizer = WhitespaceSplit()
    tok.save(str(tmp_path / "t.json"))
    (tmp_path / "m.onnx").write_bytes(_model())
    return embed.OnnxProvider(str(tmp_path / "m.onnx"), str(tmp_path / "t.json"), max_length=4)


def test_onnx_provider(provider):
    """Truncated at four tokens, padding masked out of the mean, length one."""
    got = provider(["red green", "blue", "red red red green blue blue"])
    for row, ids in zip(got, ([2, 3], [4], [2, 2, 2, 3]), strict=True):
        mean = TABLE[ids].mean(0)
        assert np.allclose(row, mean / np.linalg.norm(mean), atol=1e-5)


def test_onnx_provider_in_workers(spark, provider):
    df = spark.createDataFrame([(i, ("red", "green blue", None)[i % 3]) for i in range(70)], "id int, text string")
    out = embed.embed(df.where("id % 3 < 2").repartition(3), "text", provider)
    rows = out.withColumn("v", half_pack.unpack("embedding")).collect()
    want = provider(["red", "green blue"])
    assert all(np.allclose(r.v, want[r.id % 3], atol=2e-3) and r.dimension == 6 and abs(r.norm - 1) < 1e-2 for r in rows)
    (c,) = embed.counters(out).collect()
    assert c.total_embeddings == len(rows) == 47 and c.dimension == 6 and c.batches == 3 and c.latency_ms > 0


def test_counters_of_nothing(spark):
    empty = embed.embed(spark.createDataFrame([], "text string"), "text")
    assert embed.counters(empty).collect() == [(0, None, 0, 0.0)]


def test_hash_provider_forgets(monkeypatch):
    want = embed.HashProvider()(["a b c", "c d", ""])
    p = embed.HashProvider()
    monkeypatch.setattr(embed.HashProvider, "KEPT", 2)
    assert (p(["x y z"]) != 0).any() and (p(["a b c", "c d", ""]) == want).all()


def test_half_pack_with_nulls(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1e9])]
    got = spark.createDataFrame(rows, "i int, v array<double>").coalesce(1).select("i", half_pack.unpack(half_pack.pack("v")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [[1.0, 2.0], None, [], [float("inf")]]
