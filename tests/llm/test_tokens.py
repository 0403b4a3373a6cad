import json
import random
import zlib

import numpy as np
import pytest

from brickfield.llm import tokens
from brickfield.llm.common import new_path
from brickfield.llm.queries import vocabulary

STRANGE = [
    "It's don't THE'LL we’re x'", "É́ école naïvë ́abc", "<|endoftext|> a<|startoftext|>b <|end", "日本語 テスト 123abc45", "a\x1cb\x85c\xa0d e​f",
    "İstanbul ẞ ﬁ ǅ ªº", "\x00 \x01x", "", "  ", "...!!! --- a.b.c foo_bar -x- 'tis rock'n'roll'", "ΑΣ Σ", "🙂🙂 a🙂", "word... WORD,, Wörd!?", "\0 end",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_encoder_equals_library(tokenizer):
    encoder = tokens.Encoder(vocabulary(), 1)
    for _ in range(2):
        ids, counts = encoder([t.encode() for t in STRANGE] + [None])
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in STRANGE] + [[1]]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_latin_words_before_punctuation(tokenizer):
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts = [w + p for c in letters for w in (c, "K" + c, "K" + c + "e" + c) for p in (",", ".", "?!", ")", "…")] + ["Kİ, KİŞİ. İİ- İ"]
    ids, counts = tokens.Encoder(vocabulary(), 1)([t.encode() for t in texts])
    found = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_encoder_forgets(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    encoder = tokens.Encoder(vocabulary(), 1)
    for t in STRANGE:
        assert encoder([t.encode()])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_round_trip(spark, docs, corpus, tokenizer):
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    folder = new_path(spark, "t")
    shards = tokens.write_tokens(docs, folder, vocabulary(), length=64)
    got = sorted(map(tuple, tokens.read_documents(shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in order]
    at = 0
    for doc_id, start, n, crc in got:
        assert start == at
        at += n
        texts = [t for i, t, _ in corpus if i == doc_id]
        ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for t in texts]
        assert (n, crc) in {(len(x), zlib.crc32(x.tobytes())) for x in ids}


def test_random_access(spark, docs):
    shards = tokens.write_tokens(docs, new_path(spark, "t"), vocabulary(), length=64).collect()
    for row in shards:
        shard = tokens.Shard(row["path"])
        last = shard.mask(row["sequences"] - 1)
        assert len(shard.sequence(0)) == 64 and last[0]
        assert 64 * (row["sequences"] - 1) + last.sum() == row["tokens"]
        stream = np.concatenate([shard.sequence(i)[shard.mask(i)] for i in range(row["sequences"])])
        assert (stream == 1).sum() >= row["docs"]


def test_empty(spark, no_docs):
    assert tokens.token_digest(spark, no_docs, new_path(spark, "t"), vocabulary()).count() == 0


def test_fuzzed_words_equal_library(tokenizer):
    """Words of letters with and without marks, ligatures and specials, beside punctuation, digits and one another."""
    rng = random.Random(9)
    letters = [*"aZéİıŞßŸſǅŋ", "i\u0307", "e\u0301", "\u0301", "\u0130\u0307", "ﬁ", "ẞ", "Σ", "ς", "日", "🙂", "\u200d", "'s", "'", "’", "\xa0", "\x85", "<|endoftext|>"]
    ends = [*".,;:!?)(-_\"'/…", "", "", "1", "2.5", " ", "\t", "\x00", "\x1c"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) + rng.choice(ends) + rng.choice(letters) * rng.randint(0, 1) + rng.choice(ends) for _ in range(120_000)]
    ids, counts = tokens.Encoder(vocabulary(), 1)([t.encode() for t in texts])
    want = [x.ids + [1] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "cased"])
def test_other_vocabularies(tokenizer, tmp_path, name):
    """A tokenizer that keeps white space, and one of this form that keeps case, encode whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    if name == "cased":
        spec = json.loads(tokenizer.to_str())
        spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
        path = str(tmp_path / "cased.json")
        (tmp_path / "cased.json").write_text(json.dumps(spec))
    else:
        path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), tokens.Encoder(path, 0)
    assert encoder.whole and not tokens.Encoder(vocabulary(), 1).whole
    ids, counts = encoder([t.encode() for t in STRANGE] + [None])
    want = [library.encode(t, add_special_tokens=False).ids + [0] for t in [*STRANGE, ""]]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_extra_columns_are_not_written(spark, docs):
    shards = tokens.write_tokens(docs, new_path(spark, "t"), vocabulary(), length=64)
    for r in shards.collect():
        shard = tokens.Shard(r["path"])
        assert shard.stream.schema.names == ["ids", "mask"] and shard.docs.column_names == ["doc_id", "n_tokens"]
    assert tokens.read_documents(shards).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
