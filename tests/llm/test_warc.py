import gzip
import hashlib
import io
from collections import Counter

import pytest

from brickfield.llm import warc
from brickfield.llm.common import new_path

LONG, OTHER = "<p>é\r\n\r\n" + "x" * 2000, "<p>" + "yz" * 700
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, None, LONG), (3, "http://b\r\nX: 1", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", OTHER), (7, "u", OTHER), (None, "u", OTHER), (-8, "u", "\x1f\x8b\x08" * 400)]


def expected(pages):
    keeper = {}
    for i, _, h in pages:
        keeper[h or ""] = max(keeper.get(h or "", float("-inf")), float("-inf") if i is None else i)
    out = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= 1000 and i != keeper[h or ""]
        out[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", keeper[h or ""] if again else None)] += 1
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    got = Counter(tuple(r) for r in warc.warc_digest(spark, pages, new_path(spark, "w")).collect())
    assert got == expected(PAGES)


@pytest.mark.parametrize("size", [7, 64, 300, 5000])
def test_any_split_owns_each_record_once(spark, size):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    folder = new_path(spark, "w")
    assert warc.write_warc(pages, folder) == len(PAGES)
    whole = Counter((r["record_id"], r["offset"], bytes(r["payload"])) for r in warc.read_warc(spark, folder).collect())
    if size >= 64:
        split = Counter((r["record_id"], r["offset"], bytes(r["payload"])) for r in warc.read_warc(spark, folder, size).collect())
        assert split == whole
    assert sum(whole.values()) == len(PAGES)


def test_false_magic_is_passed_over():
    inner = gzip.compress(b"not a record")
    one = gzip.compress(warc.record(1, "u", b"abc", "d", None))
    data = warc.MAGIC + b"junk" + inner + one + warc.MAGIC + one + b"tail"
    for size in (5, 40, 1000):
        got = [r[0] for s in range(0, len(data), size) for r in warc.records_in(io.BytesIO(data), s, min(s + size, len(data)))]
        assert got == [len(warc.MAGIC) + 4 + len(inner), len(data) - 4 - len(one)]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_digest(spark, pages, new_path(spark, "w")).count() == 0
