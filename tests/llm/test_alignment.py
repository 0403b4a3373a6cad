import hashlib
import random
from collections import Counter

import pytest

from brickfield.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(texts):
    """The report of each text, token by token, straight from the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    char = alignment.byte_of()
    spans = []
    for t in texts:
        own = []
        if t:
            whole = (" " + t).encode()
            x = [(i, bytes(char[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            if b"".join(s for _, s in x) == whole == b"".join(s for _, s in y):
                for side in (x, y):
                    at, rows = 0, []
                    for i, s in side:
                        rows.append((i, at, at + len(s)))
                        at += len(s)
                    own.append(rows)
        spans.append(own or [[], []])
    links = [[(i, j) for i, s, e in x for j, f, g in y if s < g and f < e] for x, y in spans]
    counts = Counter(p for each in links for p in each)
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for (x, y), own in zip(spans, links):
        ends = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, at = [], 0
        for end in ends:
            side = lambda rows: ",".join(str(i) for i, s, e in rows if at <= s and e <= end)  # noqa: B023, E731
            groups.append(f"{side(x)}|{side(y)}")
            at = end
        said = ";".join(groups)
        out.append((len(x), len(y), len(ends), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out, counts


def texts():
    rng = random.Random(4)
    parts = ["the", "Straße", "naïve", "  ", "\n", "\t", "日本語", "😀", "don't", "<s>", "<|endoftext|>", "<0x41>", "1234", "é", "\x00", "ﬁ", "foo_bar", "...", "über", "İ"]
    made = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    return [*made, None, "", " ", "x", "a ▁ b", "▁", "word " * 300, made[0], made[0], "a" * 5000, " leading", "trailing "]


@pytest.mark.parametrize("together", [1 << 19, 40])
def test_matches_token_by_token(spark, monkeypatch, together):
    for name in ("TOKENS", "TEXTS", "HELD"):
        monkeypatch.setattr(alignment, name, together)
    rows = [(i // 2, t, 7, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long, key string").repartition(3)
    found, shards = alignment.align(spark, docs, A, B)
    want, counts = brute([t for _, t, *_ in rows])
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, *w) for (i, *_), w in zip(rows, want))
    assert sum(w[0] == 0 for w in want) >= 4 and sum(w[2] > 0 for w in want) > 50
    assert {(r["a"], r["b"]): r["n"] for r in alignment.pair_table(shards).collect()} == counts


def test_none(spark):
    found, shards = alignment.align(spark, spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert found.count() == 0 and alignment.pair_table(shards).count() == 0
    found, _ = alignment.align(spark, spark.createDataFrame([(None, None), (3, "")], "doc_id long, text string"), A, B)
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_other_files_go_through_the_library(tmp_path):
    import json

    spec = json.load(open(A))
    spec["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other, own = alignment.ByteLevel(str(tmp_path / "other.json")), alignment.ByteLevel(A)
    assert other.fast is None and own.fast
    said = [" " + t for t in texts() if t]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    assert own.encode(said) == [x.ids for x in library.encode_batch(said, add_special_tokens=False)]
    assert b"".join(map(other.bytes.__getitem__, other.encode([" it's"])[0])) == b" it's"
