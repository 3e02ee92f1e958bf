"""Long and odd inputs that an operator must take whole."""

import gc
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tripleforge.llm import byte_bpe, common, mixing, ngram_join, pii, token_files


def test_mixing_cuts_a_long_document(spark):
    text = "\t " + "".join(f"w{i}" + (" ", "\n\n", " \x0b\t")[i % 3] for i in range(20_000))
    table = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    row = mixing.mixed_documents(table, ["doc_id", "text", "n_chars"], share=0.9).collect()
    want = re.match(r"\s*(?:\S+\s+){17999}\S+", text).group()
    assert [(r.doc_id, r.text, r.n_chars) for r in row] == [(1, want, len(want))]


@pytest.mark.parametrize("pull", [0.0, 0.5])
def test_pii_labels_every_later_mention(pull):
    field = pii.SkipChainField()
    field.unary[3 * pii.N_SHAPE, pii.NONE] = pull
    text = "call +12345557586 today" + " and again the number 12345557586 there" * 50
    base, spans = field.label([text])[0]
    assert len(base) == 1 and len(spans) == 51 and {pii.KINDS[k] for _, k, _ in spans} == {"phone"}
    assert field.label(["a 7 b", text, ""])[1] == (base, spans)


def test_keep_first_takes_rows_without_an_id_and_rows_that_share_one(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    near_a = a + " more"
    rows = [(7, a), (3, near_a), (None, a), (None, b), (None, b), (5, c), (5, d), (5, d + " more"), (6, c), (8, None), (9, ""), (None, None), (None, None), (None, "x")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in ngram_join.keep_first(table, 5, 80).collect()]
    d_kept = [x for x in got if x in ((5, d), (5, d + " more"))]
    assert len(d_kept) == 1
    assert sorted(map(repr, got)) == sorted(map(repr, [(3, near_a), (None, b), (5, c), *d_kept, (8, None), (9, ""), (None, None), (None, "x")]))


def test_encoder_gives_added_tokens_their_own_ids():
    path = P.path("byte_bpe_50k.json")
    encoder, plain = token_files.Encoder(path, 0, np.uint16), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    parts = ["a", " ", "\n", "word", ",", ".", "  ", "\t", "é", "12", "<|endoftext|>", " <|endoftext|>,", "\n<|endoftext|>", " "]
    texts = ["<|endoftext|>", *["".join(parts[i] for i in rng.integers(0, len(parts), 14)) for _ in range(2000)]]
    ids, n = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*x.ids, 0] for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(pa.array(texts[:1]))[0].tolist() == [50256, 0]


def test_longs_are_the_values_given(spark):
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 100_000):  # the last in several pieces
        values = rng.integers(-(2**63), 2**63 - 1, n)
        assert spark.range(1).select(byte_bpe.longs(spark, values).alias("x")).first().x == values.tolist()


def test_materialize_tidies_a_grown_heap(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory
    used = lambda: beans.getMemoryMXBean().getHeapMemoryUsage().getUsed() >> 20
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    spark._jvm.System.gc()
    least = used()
    for _ in range(8):
        spark.sparkContext._gateway.new_array(spark._jvm.long, 1 << 22)  # 32 MB each, which the next collection of Python's drops
    gc.collect()
    assert common.materialize(spark.range(3), "tidy").count() == 3
    assert used() < least + 100


@pytest.mark.parametrize("edges, rounds", [([(1, x) for x in range(2, 40)], 1), ([(x, x + 1) for x in range(1, 40)], None), ([(5, 5), (7, 3), (3, 9), (9, 8)], None)])
def test_components_end_at_stars(spark, monkeypatch, edges, rounds):
    made = []
    plain = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: made.append(name) or plain(df, name))
    got = dict(common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert rounds is None or len(made) == 1 + rounds
