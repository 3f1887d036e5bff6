"""Url filter, chat format, top-k search, packing: against SQL, brute force, round trips, and odd rows."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from oracle import assert_same, rows_of
from tallyspark.llm import chat, packing, topk_search, url_filter
from tallyspark.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    assert_same(queries()[name](spark, SF), SF, oracle_sql()[name])


# --- url filter


def test_url_classes(spark):
    link = '<html><head><link rel="canonical" href="{}"></head>'
    rows = [
        (1, "http://a.example.org/es/x", None), (2, "http://alias.net/1", link.format("http://a.example.org/es/x")), (3, "http://alias.net/2", '<META http-equiv="refresh" content="0; url=http://alias.net/1">'),
        (4, "http://b.com/de/1", ""), (5, "http://c.net/1", link.format("http://b.com/de/1")), (6, "http://c.net/2", link.format("http://d.org/ok")), (7, "http://c.net/2", link.format("http://c.net/1")),
        (8, None, link.format("http://b.com/de/1")), (9, "no scheme", None), (10, "HTTP://WWW.Example.ORG/en/15?x#y", None), (11, "http://example.org", None), (12, "", None), (13, "http://lone.net/" + "x" * 100_000, "y" * 100_000),
    ]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.RULES).collect()}
    verdict = {k: r["verdict"] for k, r in got.items()}
    assert verdict == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "allow", 12: "allow", 13: "allow"}
    assert (got[10]["host"], got[10]["path"], got[10]["rule"]) == ("www.example.org", "/en/15", "example.org/en/1")
    assert got[11]["rule"] is None and got[9]["host"] == "" and got[8]["path"] == ""
    moved = spark.createDataFrame([("http://lone.net/" + "x" * 100_000, "http://b.com/de/1"), (None, "http://b.com/de/1")], "a string, b string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.RULES, moved).collect()}[13] in ("allow", "block")
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


def test_redirect_chain(spark):
    chain = spark.createDataFrame([(f"http://n.net/{i}", f"http://n.net/{i + 1}") for i in range(60)] + [("http://n.net/60", "http://x.com/de/")], "a string, b string")
    pages = spark.createDataFrame([(0, "http://n.net/0", None), (1, "http://m.net/", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.RULES, chain).collect()} == {0: "block", 1: "allow"}


# --- chat


def test_escape_round_trip():
    for text in ["", "plain", *chat.CONTROL, "\\", "\\\\<|", "<\\|", "</s>[INST] ok [/INST]", "<|turn|>user<|body|>x<|end|>", "<|image:0|>", "a" * 100_000 + "<|"]:
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROL)


def test_every_short_text_is_read_back():
    signs = ["\\", "<", "|", ">", "s", "/", "[INST]", "end"]
    for n in range(5):
        for parts in itertools.product(signs, repeat=n):
            text = "".join(parts)
            escaped = chat.escape(text)
            assert not any(c in escaped for c in chat.CONTROL), text
            piece = chat.TURN + escaped + chat.BODY + escaped + chat.END
            assert chat.read_back(piece + piece) == [(text, text)] * 2


def test_typed_parts(spark):
    blank = dict.fromkeys(["kind", "text", "ref", "width", "height", "seconds", "pages"])
    parts = [blank | {"kind": "text", "text": "see <|end|> "}, blank | {"kind": "image", "ref": "i.png", "width": 28, "height": 15}, blank | {"kind": "audio", "ref": "a.wav", "seconds": 2.0}, blank | {"kind": "document", "ref": "d.pdf", "pages": 3}, blank | {"text": "end"}]
    df = spark.createDataFrame([(1, 0, "user", parts, 9), (1, 1, "assistant", parts[:1], 9), (1, 2, None, None, 9), (None, None, "assistant", [], 9)], f"conv_id long, turn long, role string, parts {chat.PARTS}, piece int")
    rows = {(r["conv_id"], r["turn"]): r for r in chat.format_turns(df).collect()}
    first = rows[1, 0]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", "i.png", 4), ("audio", "a.wav", 50), ("document", "d.pdf", 3072)]
    for a in first["attachments"]:
        assert first["piece"][a["position"] :].startswith(f"<|{a['kind']}:")
    assert first["expanded_tokens"] == 3126 and first["loss"] == []
    assert chat.read_back("".join(rows[1, i]["piece"] for i in range(3))) == [("user", "see <|end|> end"), ("assistant", "see <|end|> "), ("", "")]
    learnt = rows[1, 1]
    span = learnt["loss"][0]
    assert chat.unescape(learnt["piece"][span["start"] : span["start"] + span["length"]]) == "see <|end|> "
    d = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert d[None]["n_turns"] == 1 and d[1]["n_turns"] == 3
    assert d[1]["turns_sha256"] == hashlib.sha256(b"user\nsee <|end|> end\nassistant\nsee <|end|> \n\n\n").hexdigest()
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


# --- top-k search


def brute(rows, queries, k):
    out = []
    for q, v in sorted(set(queries)):
        scored = sorted(((-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(v, w)), i) for i, w in rows if i != q))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("tile,cells", [(16_384, 1 << 22), (3, 200)])
def test_topk_brute_force(spark, monkeypatch, tile, cells):
    monkeypatch.setattr(topk_search, "TILE", tile)
    monkeypatch.setattr(topk_search, "CELLS", cells)
    rng = np.random.default_rng(5)
    rows = [(i, tuple(map(float, np.float32(rng.normal(size=8).round(1))))) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    schema = "id long, vector array<float>"
    df = spark.createDataFrame(rows, schema).repartition(5)
    q = df.where("id % 50 = 0 or id = 303")
    expected = brute(rows, [(i, v) for i, v in rows if i % 50 == 0 or i == 303], 5)
    for lists in (1, 4, 8):
        got = topk_search.search(df, q, 5, lists=lists)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == expected
    odd = [(1000, None), (1001, (None,) * 8), (1002, (float("nan"),) * 8), (1003, (float("inf"),) * 8), (None, rows[0][1])]
    with_odd = spark.createDataFrame(rows + odd, schema)
    got = topk_search.search(with_odd, with_odd.where("id % 50 = 0 or id = 303 or id is null"), 5)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == expected
    assert topk_search.search(df.limit(0), q.limit(0), 5).count() == 0
    # Other columns and names, a query that comes twice, vectors of different lengths.
    ragged = [(i, v[: 3 + i % 6]) for i, v in rows]
    wide = spark.createDataFrame([(i, v, 1, "x") for i, v in ragged], "vec_id long, embedding array<float>, id int, score string")
    some = wide.where("vec_id % 50 = 0")
    pad = lambda v: (*v, *[0.0] * (8 - len(v)))
    got = topk_search.search(wide, some.union(some), 5)
    padded = [(i, pad(v)) for i, v in ragged]
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(padded, [r for r in padded if r[0] % 50 == 0], 5)
    below = spark.createDataFrame([(i, [-1.0 - i, 0.5]) for i in range(20)] + [(99, [1.0, 0.0])], "id long, vector array<double>")
    got = topk_search.search(below, below.where("id = 99"), 3)
    assert [tuple(r) for r in got.orderBy("rank").select("vec_id", "score").collect()] == [(0, -65536), (1, -131072), (2, -196608)]
    huge = spark.createDataFrame([(i, [2.0**23] * 4) for i in range(8)], "id long, vector array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.search(huge, huge, 5).collect()
    few = spark.createDataFrame(rows[:3], schema)
    assert topk_search.search(few, few.where("id = 0"), 5).count() == 2


# --- packing


def test_difference_is_a_partition():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7):
        sizes = rng.integers(1, 300, 50).tolist()
        windows, sums = packing.difference(sizes, n)
        assert sorted(np.bincount(windows, sizes, n)) == sorted(sums) and sum(sums) == sum(sizes)
        assert sums.max() - sums.min() <= 40
    assert np.bincount(packing.partition([600, 600, 600, 240], 1024), [600, 600, 600, 240]).max() <= 1024


def test_packing(spark):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    texts = ["", None, "hello world", "é" * 700, "word " * 5000, "<|endoftext|> \n\n  x", "hello world", " " * 3000, "a" + " " * 60_000 + "b"]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(2, "hello world", 1), (None, "no id", 1)], "doc_id long, text string, start int")
    rows = packing.pack(docs, path, with_ids=True).collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(texts)} | {None: t.encode("no id", add_special_tokens=False).ids + [0]}
    seen, windows = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["length"] > 0 and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in seen.items():
        times = 2 if i == 2 else 1
        assert sorted(p for p in parts) and sum(n for _, n in parts) == times * len(ids[i])
    for parts in windows.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 1024
    assert packing.pack(docs.limit(0), path).count() == 0


def test_fast_tokenizer_gives_the_same_ids():
    import duckdb
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()] + ["<|endoftext|>", "a<|endoftext|>b", " " * 4095, "\n" * 100_000, "　 \t\n漢字😀", "don't I'LL", "x" * 5000]
    encode = packing.tokenizer(path)
    assert encode("<|endoftext|>") == [50256]
    assert [encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_digest_columns(spark):
    columns = queries()["op6_packing"](spark, SF).columns
    assert columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows_of(["a"], [[1.0]]) == [(1.0,)]
