"""Language, toxicity, quality: held-out accuracy, no leaks, odd rows; sampling of segmentations against enumeration."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language_id, quality, sentencepiece_sampling, toxicity
from tallyspark.llm.common import table
from tallyspark.llm.queries import queries

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_language_accuracy(spark):
    got = queries()["op2_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == table(spark, SF, "documents").count()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("name,label", [("op9_toxicity", "toxic"), ("op10_quality", "quality")])
def test_scores_on_held_out(spark, name, label):
    got = queries()[name](spark, SF).join(table(spark, SF, "labels"), "doc_id", "left").toPandas()
    assert len(got) == table(spark, SF, "documents").count() and got.score.between(0, 1).all()
    held = got[got.held_out & got[label].notna()]
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > 0.85


def odd(spark):
    return spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "123 !!", 7), (4, "word " * 300_000, 7), (None, "some text", 7), (5, "a", 7), (5, "a", 7), (6, "\x00퟿😀", 7)], "doc_id long, text string, score int")


def test_odd_rows(spark):
    docs = table(spark, SF, "documents").limit(300)
    model = language_id.learn(docs)
    got = {(r["doc_id"]): r for r in language_id.identify(odd(spark), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] != "und" and got[1]["score"] == 0
    assert language_id.identify(odd(spark), model).count() == 8
    assert {r["lang_pred"] for r in language_id.identify(odd(spark), language_id.learn(docs.limit(0))).collect()} == {"und"}
    labels = table(spark, SF, "labels")
    tox = toxicity.learn(docs, labels.select("doc_id", "toxic"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(odd(spark), tox).collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(odd(spark), toxicity.learn(docs, labels.limit(0).select("doc_id", "toxic"))).count() == 8
    stats = quality.with_statistics(odd(spark))
    q = quality.learn(quality.with_statistics(docs), labels.select("doc_id", "quality"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(stats, q).collect())
    assert {r["score"] for r in quality.score(stats, quality.learn(stats, labels.limit(0).select("doc_id", "quality"))).collect()} == {1.0}
    for empty in (language_id.identify(odd(spark).limit(0), model), toxicity.score(odd(spark).limit(0), tox), quality.score(stats.limit(0), q)):
        assert empty.count() == 0


def test_long_texts_in_pieces():
    import pyarrow as pa

    from tallyspark.llm import ngrams
    from tallyspark.llm.common import segments

    text = "abc def " * 300_000
    assert "".join("".join(map(chr, codes[: 1_000_000 - 3 if i < 2 else None])) for i, (codes, _, _) in enumerate(segments(pa.array([text]), limit=1_000_000, overlap=3))) == text
    held = lambda texts: [set(b) for _, got in ngrams.distinct_grams(pa.array(texts), range(2, 5), 22) for b in got]
    long = held(["y", text, text, "x", None])
    assert long[1] == long[2] == held(["abc def " * 40])[0] and len(long) == 5 and long[0] == long[4] == set()
    assert [r for rows, _ in ngrams.distinct_grams(pa.array(["y", text, text, "x"]), range(2, 5), 22) for r in rows] == [0, 1, 2, 3]
    assert all(len(b) == len(set(b)) for _, got in ngrams.distinct_grams(pa.array(["banana", "nananana"]), range(2, 5), 22) for b in got)


def test_isotonic():
    out = quality.isotonic(np.array([2, 2, 0, 2]), np.array([1, 0, 0, 2]))
    assert (np.diff(out) >= 0).all() and abs(out[0] - 0.25) < 1e-3 and out[-1] == pytest.approx(1.0)


# --- segmentations


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def enumerate_all(unit, v):
    """All segmentations of a short unit with their weights, by plain recursion over the model's own pieces."""
    weight = {}
    for i in range(v.n):
        if not (v.model.is_control(i) or v.model.is_unknown(i) or v.model.is_byte(i)):
            weight[v.model.id_to_piece(i)] = (i, -np.log1p(min(-v.model.get_score(i), v.n)))

    def rest(at):
        if at == len(unit):
            return [((), 0.0)]
        return [((weight[unit[at:to]][0], *ids), weight[unit[at:to]][1] + w) for to in range(at + 1, len(unit) + 1) if unit[at:to] in weight for ids, w in rest(to)]

    found = rest(0)
    total = np.logaddexp.reduce([w for _, w in found])
    return {ids: w - total for ids, w in found}


def test_samples_follow_the_distribution():
    v = sentencepiece_sampling.vocabulary(model_path())
    for text in ("hello", "toto a"):
        exact = enumerate_all("▁" + text.replace(" ", "▁"), v)
        n, k = 6000, 3
        got = sentencepiece_sampling.samples(np.arange(n), [text] * n, k, v)
        first, total, chosen = Counter(), np.zeros(n), [set() for _ in range(n)]
        before = np.full(n, np.inf)
        for ids, offsets, paths, inclusion in got:
            for i in np.flatnonzero(paths.exists):
                z = tuple(ids[offsets[i] : offsets[i + 1]].tolist())
                assert abs(exact[z] - paths.total[i]) < 1e-3 and z not in chosen[i]
                chosen[i].add(z)
                if paths is got[0][2]:
                    first[z] += 1
            total += np.where(paths.exists, np.exp(paths.total) / inclusion, 0)
            assert (paths.bound <= before + 1e-9).all()
            before = paths.bound
        assert abs(total.mean() - 1) < 0.01
        for z, p in exact.items():
            assert abs(first[z] / n - np.exp(p)) < 4 * np.sqrt(np.exp(p) / n) + 1e-3


def test_sampling_round_trip(spark):
    texts = ["", None, "hello world", "  two  spaces\nand é 漢 😀 ", "x" * 5000, "a", "▁ literal", "one two " * 3000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, "hello world", 1), (None, "no id", 1)], "doc_id long, text string, rank int")
    out = sentencepiece_sampling.sample(docs, model_path(), k=3, seed=1)
    back = sentencepiece_sampling.decode(out.select("doc_id", "ids"), model_path())
    for r in back.collect():
        expected = "no id" if r["doc_id"] is None else texts[r["doc_id"]]
        assert r["text"] == expected.replace("▁", " ")
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows)[0] == 1 and Counter(r["doc_id"] for r in rows)[2] == 6 and 1 not in {r["doc_id"] for r in rows}
    again = sentencepiece_sampling.sample(docs.repartition(7), model_path(), k=3, seed=1)
    key = lambda r: (str(r["doc_id"]), r["rank"], tuple(r["ids"]))
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))
    assert sentencepiece_sampling.sample(docs.limit(0), model_path()).count() == 0
    plain = sentencepiece_sampling.encode(docs, model_path())
    assert {r["text"] for r in sentencepiece_sampling.decode(plain, model_path()).where(F.col("doc_id") == 3).collect()} == {texts[3]}
