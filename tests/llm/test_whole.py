"""Whole inputs: texts, links, segmentations and pieces that a shortcut would leave out."""

import hashlib
import math
from urllib.parse import urljoin

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tallyspark.llm import chat, sentencepiece_sampling, url_filter


def test_digests_of_texts_ending_in_backslashes(spark):
    blank = dict.fromkeys(["kind", "text", "ref", "width", "height", "seconds", "pages"])
    image = blank | {"kind": "image", "ref": "i.png"}
    texts = ["a\\", "a\\\\", "\\", "\\\\\\", "<|\\", "plain", "<\\|end|>\\"]
    turns = [(role, text) for role in ("user", "assistant", "user\\", "\\\\") for text in texts]
    rows = [(i % 2, i, role, [blank | {"text": text}, image, blank | {"text": text}]) for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    for conv in (0, 1):
        mine = turns[conv::2]
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text * 2}\n" for role, text in mine).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256("".join(text * 2 for role, text in mine if role == "assistant").encode()).hexdigest()


def test_relative_targets(spark):
    bases = ["http://h.org", "http://h.org/", "https://h.org/a/b?x=1#f", "http://h.org/a/b/", "http://h.org/a/b/c.html?u=http://q/r", "HTTP://H.org:80/a"]
    targets = ["/en/1", "//other.com/p", "//other.com/p?q", "x", "x/y?z#w", "./x", "../x", "../../../x", ".", "..", "../", "a/./b/../c", "?q=1", "#f", "/", "/a/../b/.", "/r?to=http://z/", "x?u=/../y", "http://abs.net/../x", "ftp://f/g"]
    rows = [(b, t) for b in bases for t in targets]
    got = spark.createDataFrame(rows, "url string, t string").select("url", "t", url_filter.resolved(F.col("t"), F.col("url"))).collect()
    scheme = lambda b, x: x if b[:4] != "HTTP" else x.replace("http:", "HTTP:", 1)
    expected = [(b, t, t if t[:5] in ("http:", "ftp:/") else scheme(b, urljoin(b, t))) for b, t in rows]
    assert [tuple(r) for r in got] == expected
    odd = spark.createDataFrame([("no scheme", "/x"), ("http://h.org/", "mailto:a@b"), ("http://h.org/", "javascript:x"), ("http://h.org/", ""), ("http://h.org/", None)], "url string, t string")
    assert [r[0] for r in odd.select(url_filter.resolved(F.col("t"), F.col("url"))).collect()] == [None] * 5


def test_links_in_any_case_and_relative(spark):
    rows = [
        (1, "http://h.net/1", '<META HTTP-Equiv="refresh" content="0; URL=http://x.com/de/1">'), (2, "http://h.net/2", '<meta http-Equiv=refresh content="0;url=http://x.com/de/2">'), (3, "http://h.net/3", '<LINK REL="cAnonical" HREF="http://x.com/de/3">'),
        (4, "http://h.net/4", '<link rel="canonical" href="/1">'), (5, "http://h.net/a/5", '<link rel="canonical" href="../4">'), (6, "http://h.net/6", '<link rel="canonical" href="//x.com/fr/6">'), (7, "http://x.com/es/7", '<meta http-equiv="refresh" content="0; url=/de/7">'), (8, "http://h.net/8", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.RULES).collect()}
    assert verdict == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block", 8: "allow"}


def test_all_segmentations_of_short_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = sentencepiece_sampling.vocabulary(path)
    piece = {v.model.id_to_piece(i): i for i in range(v.n) if not (v.model.is_control(i) or v.model.is_unknown(i) or v.model.is_byte(i))}

    def ways(text):
        if not text:
            yield (), 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in piece:
                for ids, weight in ways(text[n:]):
                    yield (piece[text[:n]], *ids), weight - math.log1p(min(-v.model.get_score(piece[text[:n]]), v.n))

    for text in ["a", "I", "я", "a a a", "I I", "I I I I I I I", "the", "to be", "x" * 7]:
        expected = dict(ways("▁" + text.replace(" ", "▁")))
        total = math.log(math.fsum(map(math.exp, expected.values())))
        got = {}
        for ids, offsets, paths, inclusion in sentencepiece_sampling.samples(np.arange(3), [text] * 3, len(expected) + 1, v, 1):
            for row in np.flatnonzero(paths.exists):
                got[row, tuple(ids[offsets[row] : offsets[row + 1]].tolist())] = paths.total[row], inclusion[row]
        assert set(got) == {(row, ids) for row in range(3) for ids in expected}, text
        assert max(abs(p - (expected[ids] - total)) for (_, ids), (p, _) in got.items()) < 1e-9, text
        assert min(inclusion for _, inclusion in got.values()) == 1, text
