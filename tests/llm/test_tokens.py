"""Token counts against the library that reads the vocabulary."""

import random

import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import queries, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def count():
    return tokens.counter(open(PATH, encoding="utf-8").read())


def test_every_document_as_the_library_counts_it(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_token_counts(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for (i, text), n in zip(texts.items(), library(list(texts.values()))):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(text.encode()), n > 2048)


def test_odd_characters(count, library):
    rng = random.Random(1)
    signs = "abcXYZ 019'\u2019\n\t.,!?\u0301\u00e9\u03a3\u03c3\u0130\u4e2d\u6587 \u0085\x1c\x00\u200d\U0001f600A\u030a<|>endoftext\u1e9b\u0323\u3000\ufb01"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>'s", " \u0301a", "a" * 5000, "it's 'S I'LL", "\u4e2d\u6587" * 300, "\x1c a\x1cb", " ", ""]
    assert [count(t) for t in texts] == library(texts)


def test_texts_beyond_a_chunk(count, library):
    text = ("one <|endoftext|> two\n" + "x" * 90 + " ") * 3000 + "y" * 70_000
    assert [count(text)] == library([text])


def test_new_words_of_a_text_are_counted_together(count, library):
    """Words that only hold other white space, special strings, and words that grow or shrink in their normal form stand among others."""
    texts = ["one \u00a0\u0085 two", "a\u0085b \u0085 c", "x <|endoftext|>y z", "\u0130stanbul A\u030angstr\u00f6m e\u0301e \ufb01x q\x1cr", "\u3000 \u2003w", "m n m n m"]
    assert [count(t) for t in texts] == library(texts)
    assert [count(t) for t in [" ".join(texts), *texts]] == library([" ".join(texts), *texts])


def test_full_tables_change_nothing(monkeypatch, library):
    monkeypatch.setattr(tokens, "KNOWN", 3)
    count = tokens.counter(open(PATH, encoding="utf-8").read())
    text = " ".join(random.Random(2).choice("the of and a b c d e f g hello world".split()) for _ in range(500))
    assert [count(text)] == library([text])


def test_merging_takes_the_lowest_rank_leftmost():
    # 0 0 0 0 0: ranks join the first two, then the next two; the last stays.
    assert tokens.merged([0] * 5, {(0, 0): (0, 1)}) == 3
    # (1, 2) comes before (0, 1), which it undoes.
    assert tokens.merged([0, 1, 2], {(0, 1): (1, 3), (1, 2): (0, 4)}) == 2
    assert tokens.merged([], {}) == 0


def test_clashing_columns_and_no_vocabulary(spark):
    df = spark.createDataFrame([(1, None), (None, "a b"), (1, None)], "doc_id long, text string").withColumns({c: F.lit(9) for c in ("n_bytes", "n_tokens", "over_limit")})
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df, PATH, limit=1).collect())
    assert got == [("1", 0, 0, False), ("1", 0, 0, False), ("None", 3, 2, True)]
    with pytest.raises(ValueError):
        tokens.counter('{"model": {"type": "WordPiece"}, "added_tokens": []}')


def test_tasks_of_a_worker_share_what_they_remember(monkeypatch):
    import pyarrow as pa

    made = []
    monkeypatch.setattr(tokens, "counter", lambda s: made.append(s) or len)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["abc", None]), pa.array([3, 0])], ["doc_id", "text", "n_bytes"])
    for run in ("a", "a", "a", "b"):
        assert [b.column("n_tokens").to_pylist() for b in tokens._counted("spec", run)([batch, batch])] == [[3, 0], [3, 0]]
    assert made == ["spec", "spec"]
    tokens._kept.cache_clear()
