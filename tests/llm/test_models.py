"""Operators 4, 5, 7, 9 and the pipeline: held-out accuracy, targets, recall, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointwright.llm import mixing, neighbours, quality, queries, toxicity

from .conftest import DOCS, fold, odd_rows, sentence, words

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    """600 texts: a sixth toxic by rare words, a quarter junk by form; all labelled."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        w = sentence(rng, int(rng.integers(30, 90))).split()
        toxic, junk = i % 6 == 0, i % 4 == 1
        if toxic:
            for _ in range(4):
                w[int(rng.integers(len(w)))] = ("vileword", "nastyword")[int(rng.integers(2))]
        if junk:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w) + ".", "en", "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def accuracy(scored, labels, column):
    got = scored.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    assert len(got) > 50
    return np.mean([r[0] == r[1] for r in got])


def test_toxicity_on_held_out_rows(labelled):
    df, labels = labelled
    scored = toxicity.classify(df, labels)
    assert accuracy(scored, labels, "toxic") > 0.95
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in scored.collect())


def test_toxicity_learns_nothing_from_held_out_labels(labelled):
    df, labels = labelled
    other = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.classify(df, x).collect()} for x in (labels, other))
    assert one == two


def test_toxicity_pieces_do_not_grow_with_the_number_of_batches(spark, monkeypatch):
    """600 texts in batches of 7: a piece for each chunk, not for each batch and chunk; read together they ask what single rows would, without a sort of all for each piece."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    texts = [(i, i % 3, f"word{i} the {'x' * (i % 9)} common") for i in range(600)]
    df = spark.createDataFrame(texts, "__id long, __chunk int, __bag string").coalesce(1)
    try:
        conf.set(name, "7")
        got = toxicity.bags(df, 3).toPandas()
    finally:
        conf.set(name, before)
    assert sorted(got.part) == [0, 1, 2]
    assert sum(t.num_rows for t in toxicity.joined(got.blob)) == 600
    parts = [t.slice(i, 1) for b in got.blob for t in [toxicity.unpack_table(b)] for i in range(t.num_rows)]
    blobs = [toxicity.pack_table(t) for t in parts]
    assert len(list(toxicity.joined(blobs))) == 1 and len(list(toxicity.joined(blobs, 100))) > 100
    rows, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: (rows.append(len(x)), unique(x, *a, **k))[1])
    keys, held = np.arange(400_000, dtype=np.uint64) * np.uint64(7) % np.uint64(399_989), toxicity.Distinct()
    for i in range(0, len(keys), 500):
        held.add(keys[i : i + 500])
    assert np.array_equal(held.keys(), unique(keys)) and sum(rows) < 6 * len(keys)


def test_toxicity_counts_the_tuning_fold(labelled, monkeypatch):
    """An n-gram of one text of the tuning fold is in the final models' table, not in the calibration's."""
    df, labels = labelled
    i = next(i for i in range(600) if fold(i, 5) == 1)
    models, made = [], toxicity.Model.__init__
    monkeypatch.setattr(toxicity.Model, "__init__", lambda self, counted: (made(self, counted), models.append(self))[0])
    toxicity.classify(df.withColumn("text", F.when(F.col("doc_id") == i, F.lit("zqxjk")).otherwise(F.col("text"))), labels)
    key = int.from_bytes(b"zqxjk", "big")
    assert [m.table.where(F.col("key") == key).count() for m in models] == [0, 1]


def grams_of(text):
    """The n-grams of a text's words, with repeats, by plain loops."""
    for w in words(text):
        p = b" " * (toxicity.ORDER - 1) + bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode()) + b" "
        yield [p[i : i + toxicity.ORDER] for i in range(len(p) - toxicity.ORDER + 1)]


def kneser_ney_brute(texts):
    """Evidence of an n-gram by class-conditional Kneser-Ney models of (text, toxic) rows, from dictionaries."""
    d, s = toxicity.DISCOUNT, toxicity.STRENGTH
    counts = ({}, {})
    for text, toxic in texts:
        for word in grams_of(text):
            for g in word:
                counts[1 - toxic][g] = counts[1 - toxic].get(g, 0) + 1
    both = {g: counts[0].get(g, 0) + counts[1].get(g, 0) for g in counts[0].keys() | counts[1].keys()}
    levels = [both]
    for _ in range(toxicity.ORDER - 1):
        c = {}
        for g in levels[-1]:
            c[g[1:]] = c.get(g[1:], 0) + 1
        levels.append(c)

    def of_context(c, h):
        mine = [v for g, v in c.items() if g[:-1] == h]
        return sum(mine), sum(v > 0 for v in mine)

    def shared(g):
        if not g:
            return 1 / 256
        c = levels[toxicity.ORDER - len(g)]
        total, kinds = of_context(c, g[:-1])
        return (max(c.get(g, 0) - d, 0) + d * kinds * shared(g[1:])) / total

    def evidence(g):
        if not of_context(both, g[:-1])[0]:
            return 0.0
        p = []
        for c in counts:
            total, kinds = of_context(c, g[:-1])
            p.append(((max(c.get(g, 0) - d, 0) if g in both else 0.0) + (s + d * kinds) * (shared(g) if g in both else 1.0)) / (s + total))
        return float(np.log(p[0]) - np.log(p[1]))

    return evidence


def test_kneser_ney_is_a_distribution():
    keys = np.array([int.from_bytes(bytes(g), "big") for g in ((32, 32, 32, 32, c) for c in range(97, 105))], dtype=np.uint64)
    counts = np.arange(1, 9)
    where = np.zeros(8, dtype=np.int64)
    p = toxicity.KneserNey._interpolated(counts.astype(float), where, 1 / 8)
    assert abs(p.sum() - 1) < 1e-12
    model = toxicity.KneserNey(keys, counts**3 * 100, counts[::-1] ** 3 * 100)
    assert model.evidence(keys)[-1] > 0 > model.evidence(keys)[0]
    assert toxicity.KneserNey(keys[:0], counts[:0], counts[:0]).evidence(keys).tolist() == [0.0] * 8


def test_rare_and_unseen_ngrams_are_evidence():
    """Of 40 n-grams of one toxic and one ordinary context each counted once, none is dropped; an unseen one gets its context's backoff."""
    keys = np.array([int.from_bytes(b"vile" + bytes([c]), "big") for c in range(97, 117)] + [int.from_bytes(b"good" + bytes([c]), "big") for c in range(97, 117)], dtype=np.uint64)
    toxic = np.repeat([1, 0], 20)
    model = toxicity.KneserNey(keys, toxic, 1 - toxic)
    unseen = np.array([int.from_bytes(x, "big") for x in (b"vilez", b"goodz", b"newxz")], dtype=np.uint64)
    got = model.evidence(np.concatenate((keys, unseen)))
    assert (got[:20] > 0).all() and (got[20:40] < 0).all() and got[40] != 0 and got[41] == -got[40] and got[42] == 0


def test_scores_are_those_of_brute_force_models(spark):
    """Every n-gram's evidence, and every text's features, against dictionaries and plain loops: repeats count, unseen n-grams back off."""
    rng = np.random.default_rng(8)
    texts = [(" ".join("".join("abcdé"[k] for k in rng.integers(0, 5, rng.integers(1, 6))) for _ in range(rng.integers(0, 12))), int(i % 3 == 0)) for i in range(30)] + [("vile Vile VILE thing", 1)]
    evidence = kneser_ney_brute(texts)
    model = toxicity.learn(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "__id long, text string, toxic int"))
    asked = [t for t, _ in texts] + ["vile vile ab abz new words zz", "", None, "vile " + "ab " * 30]
    got = toxicity.scored(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, np.zeros(2), 0.0).toPandas().set_index("doc_id")
    for i, t in enumerate(asked):
        each = [sum(evidence(g) for g in word) for word in grams_of(t)]
        length = sum(len(w.encode()) + 1 for w in words(t))
        assert abs(got.evidence[i] - sum(each) / max(1, length)) < 1e-5
        assert abs(got.peak[i] - max(each, default=0.0)) < 1e-5


def test_the_table_of_ngrams_is_the_model_of_all_counts(spark):
    """Every counted n-gram stands in the dealt table, whatever its share of the corpus, with the lower orders of the whole model."""
    common = " ".join(f"w{i}" for i in range(300))
    texts = [(f"{common} once{i}x", int(i == 3)) for i in range(40)] + [("rarevile", 1)]
    model = toxicity.learn(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "__id long, text string, toxic int"))
    table = model.table.toPandas().sort_values("key")
    words_ = {w for t, _ in texts for w in t.split()}
    assert set(table.key) == {int.from_bytes(p[i : i + 5], "big") for p in (b"    " + w.encode() + b" " for w in words_) for i in range(len(p) - 4)}
    whole = toxicity.KneserNey(table.key.to_numpy().view(np.uint64), table.toxic.to_numpy(), table.ordinary.to_numpy())
    assert np.allclose(table.lower, whole._lower())


def test_kept_columns_may_not_take_outputs_names(spark, clashing):
    labels = spark.createDataFrame([], LABELS)
    with pytest.raises(ValueError, match="score"):
        toxicity.classify(clashing, labels, keep=("score",))
    got = toxicity.classify(clashing, labels, keep=("part", "th"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "part", "th"] and got.count() == len(odd_rows())


def test_quality_on_held_out_rows(labelled):
    df, labels = labelled
    scored = quality.classify(df, labels)
    assert accuracy(scored, labels, "quality") > 0.95
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) for r in scored.collect())


def test_quality_sums_are_of_all_rows(spark, labelled):
    """A pass gives the parts of the risk that plain loops give, over every row, in any layout."""
    df, labels = labelled
    table = quality.measured(df).withColumn("trusted", F.col("doc_id") % 3 == 0).repartition(5).persist()
    rows = [(np.array(r.measures), r.trusted) for r in table.collect()]
    x = np.array([m for m, _ in rows])
    curve = quality.Curve(x.mean(axis=0), x.std(axis=0) + 1e-6)
    curve.w = np.random.default_rng(3).normal(0, 0.3, x.shape[1] + 1)
    got = quality.sums(table, quality.risks(curve))
    everything = positive_as_negative = positive = 0.0
    for m, trusted in rows:
        z = sum(w * max(-quality.CLIP, min(quality.CLIP, (v - a) / s)) for w, v, a, s in zip(curve.w, m, curve.mean, curve.scale, strict=False)) + curve.w[-1]
        everything += np.log1p(np.exp(z))
        if trusted:
            positive_as_negative += np.log1p(np.exp(z))
            positive += np.log1p(np.exp(-z))
    assert np.allclose(got[:3], [everything, positive_as_negative, positive])
    count = quality.sums(table, quality.moments)
    assert count[0] == 600 and count[1] == 200 and np.allclose(count[2 : 2 + x.shape[1]], x.sum(axis=0))
    again = quality.sums(table, quality.risks(curve))
    assert (got == again).all()


def test_quality_fit_is_the_least_risk():
    """No step of any one weight lowers the penalised non-negative risk; the prior comes from positives and unlabelled rows."""
    rng = np.random.default_rng(6)
    good = rng.random(3000) < 0.7
    x = rng.normal(size=(3000, 3)) + np.where(good, 1.5, -1.5)[:, None]
    trusted = good & (rng.random(3000) < 0.3)
    curve, prior = quality.fit(lambda f: f(x, trusted))
    assert abs(prior - 0.7) < 0.06

    def risk(w):
        z = curve.input(x) @ w
        negative = np.logaddexp(0, z).mean() - prior * np.logaddexp(0, z[trusted]).mean()
        return prior * np.logaddexp(0, -z[trusted]).mean() + max(0.0, negative) + quality.RIDGE / 2 * (w[:-1] ** 2).sum()

    least = risk(curve.w)
    for i in range(4):
        for by in (-0.05, 0.05):
            w = curve.w.copy()
            w[i] += by
            assert risk(w) >= least - 1e-6
    assert ((curve.score(x) >= 0.5) == good).mean() > 0.95


def test_quality_prior_by_plain_loops():
    rng = np.random.default_rng(9)
    u, p = rng.integers(0, 50, quality.BINS), rng.integers(0, 9, quality.BINS)
    best = None
    slack = np.sqrt(np.log(4 / quality.DOUBT) / (2 * u.sum())) + np.sqrt(np.log(4 / quality.DOUBT) / (2 * p.sum()))
    for at in range(quality.BINS - 1, -1, -1):
        qu, qp = u[at:].sum() / u.sum(), p[at:].sum() / p.sum()
        if qp and (best is None or (qu + slack) / qp < best[0]):
            best = ((qu + slack) / qp, qu / qp)
    assert abs(quality.prior_of(u, p) - min(0.99, max(0.01, best[1]))) < 1e-12


def test_quality_learns_nothing_from_negatives_or_held_out_rows(spark, labelled):
    df, labels = labelled
    other = labels.withColumn("quality", F.when(toxicity.fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).when(F.col("quality") == 0, F.lit(None)).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality.classify(df, x).collect()} for x in (labels, other))
    assert one == two


@pytest.mark.parametrize("f", [toxicity.classify, quality.classify])
def test_classifiers_on_odd_rows(spark, odd, clashing, none, f):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (9, 1, 0)], LABELS)
    for df in (odd, clashing):
        got = f(df, labels).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert f(none, labels).count() == 0
    assert {r.score for r in f(odd, labels.limit(0)).collect()} == {0.5}


def test_targets_are_filled_by_weight():
    t = mixing.targets([100, 1000, 10, 0])
    assert t[0] == 200 and t[2] == 20 and t[3] == 0 and abs(sum(t) - 1.5 * 1110) < 1e-9
    t = mixing.targets([500, 500, 500])
    assert np.allclose(t, [1000, 1250 / 3, 2 * 1250 / 3])


def test_permutation_and_shards():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    slots = np.array([50000, 0, 30000, 1])
    shards, _ = mixing.shards_of(int(slots.sum()))
    draws = [mixing.drawn(s, slots, 3) for s in range(shards)]
    assert sum(d.sum() for d in draws) == slots.sum() and all((d == mixing.drawn(s, slots, 3)).all() for s, d in enumerate(draws))
    found = np.sum(draws, axis=0)
    corrected = mixing.Corrected(found, slots, 3)
    placed = [corrected.place(i, np.arange(found[i])) for i in range(4)]
    sid, t = (np.concatenate(x) for x in zip(*placed, strict=True))
    assert all(sorted(t[sid == i].tolist()) == list(range(slots[i])) for i in range(4))


def mix_brute(spark, rows):
    """Words taken of each (id, text, source) row, by plain loops over the same draws and permutations."""
    order = {r.id: r.h for r in spark.createDataFrame([(r[0],) for r in rows], "id long").selectExpr("id", "shiftrightunsigned(xxhash64(id), 1) AS h").collect()}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    line = {s: [i for h, i in sorted((order[r[0]], r[0]) for r in rows if r[2] == s) for _ in words(next(r[1] for r in rows if r[0] == i))] for s in sources}
    sizes = [len(line[s]) for s in sources]
    blocks, slots = mixing.quotas(np.array(sizes), np.array(mixing.targets(sizes)), mixing.BLOCK, mixing.CAP)
    shards, _ = mixing.shards_of(int(slots.sum()))
    found = sum(mixing.drawn(s, slots, mixing.SEED) for s in range(shards))
    assert found.sum() == slots.sum()
    taken = {r[0]: 0 for r in rows}
    for i, s in enumerate(sources):
        for t in range(slots[i]):
            at = int(mixing.permuted(np.array([t % blocks[i]]), int(blocks[i]), mixing.SEED + 1_000_003 * i + t // int(blocks[i]))[0])
            for doc in line[s][at * mixing.BLOCK : (at + 1) * mixing.BLOCK]:
                taken[doc] += 1
    return taken


def test_mix_against_brute_force_in_any_layout(spark, random_docs):
    rows, df = random_docs
    want = mix_brute(spark, [(r[0], r[1], r[3]) for r in rows])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "16", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.doc_id: r.taken for r in mixing.mix(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_mix_meets_targets_and_texts_match(spark, random_docs):
    rows, df = random_docs
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    assert dict(zip(got.doc_id, got["size"], strict=True)) == {r[0]: len(words(r[1])) for r in rows}
    by = got.groupby("source").agg(target=("target", "max"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 64).all()
    again = mixing.mix(df.repartition(3)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    texts = {r.doc_id: len(words(r.text)) for r in mixing.mixed_texts(df).collect()}
    assert texts == {i: n for i, n in zip(got.doc_id, got.taken, strict=True) if n}


def test_mix_of_odd_rows(spark, odd, clashing, none):
    for df in (odd, clashing):
        got = mixing.mix(df).toPandas()
        assert len(got) == len(odd_rows()) and (got.taken <= 2 * got["size"]).all()
        texts = mixing.mixed_texts(df)
        assert texts.columns == df.columns
        assert sum(len(words(r.text)) for r in texts.collect()) == got.taken.sum()
    assert mixing.mix(none).count() == 0 and mixing.mixed_texts(none).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    got = neighbours.nearest(df).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and sorted(got.query_id.unique()) == list(range(0, 1500, 20))
    hits = [len(set(g.vec_id) & set(np.lexsort((np.arange(1500), -s[q]))[:20])) for q, g in got.groupby("query_id")]
    assert np.mean(hits) / 20 >= 0.9
    assert all(abs(r.score - s[r.query_id, r.vec_id]) < 1e-9 for r in got.itertuples())


def test_neighbours_ties_and_odd_vectors(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same, 0) for i in range(0, 60)] + [(100, [0.5, 0.5, 0.0], 0), (101, [0.0, 0.0, 0.0], 0), (102, None, 0), (120, [float("nan"), 1.0, 0.0], 0), (104, [None, 1.0, 0.0], 0), (105, [float("inf"), 0.0, 0.0], 0), (None, same, 0), (106, [1.0], 0), (0, same, 0)]
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS).withColumn("part", F.lit(1))).toPandas()
    assert sorted(got.query_id.unique()) == [0, 20, 40, 100]
    for q in (0, 20, 40):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [i for i in range(22) if i != q][:20]
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == list(range(20))
    longer = neighbours.nearest(spark.createDataFrame([*rows, (140, [1.0, 0.0, 0.0, 9.0], 0), (20, None, 0), (20, [0.0, 0.0, 0.0], 0)], VECTORS)).toPandas()
    assert sorted(longer.query_id.unique()) == [0, 20, 40, 100] and len(longer) == len(got)
    none = spark.createDataFrame([], VECTORS)
    assert neighbours.nearest(none).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, same, 0), (1, same, 0)], VECTORS)).collect()[0].vec_id == 1


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).persist()
        assert 0 < docs.count() <= before, name
        assert i == 4 or docs.columns == columns
    assert docs.count() == corpus_pipeline.run(spark, sf).count()


def test_pipeline_stages_against_operators(spark, random_docs):
    rows, df = random_docs
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()}
    from .test_dedup import cut_brute, join_brute

    assert kept == {c for _, _, c in join_brute([(r[0], r[1]) for r in rows], 5, 75)}
    cut = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, df, "").collect()}
    for i, _, gone, text in cut_brute([(r[0], r[1]) for r in rows], 13):
        assert (words(cut[i].text) == words(text)) and cut[i].n_chars == len(cut[i].text) and (gone or cut[i].text == next(r[1] for r in rows if r[0] == i))


def test_pipeline_on_odd_and_empty_rows(spark, odd, clashing, none):
    sf = "/root/testdata/sf0.001"
    for docs in (odd, clashing, none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf).persist()
            assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns, name
        assert docs.count() <= len(odd_rows())


def test_pipeline_batches_are_small(spark):
    """12 MB of texts reach a stage's workers in batches of 4 MB and a row at most, whatever the session had before."""
    docs = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(1 << 20)).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    queries.small_batches(spark)
    stage = corpus_pipeline._stage(lambda spark, docs, sf: docs.mapInArrow(sizes, "rows long, size long"))
    got = stage(spark, docs, "").collect()
    assert sum(r.rows for r in got) == 12 and max(r["size"] for r in got) < 6 << 20


def test_meetings_at_many_nodes_are_those_at_each():
    """Offers of hosts together are those of each host alone, where a neighbour may be a guest too and lists are of any length."""
    rng = np.random.default_rng(5)
    m, d, k = 40, 8, neighbours.NEIGHBOURS
    q, scale = neighbours._quantised(rng.normal(size=(m, d)))
    near = np.stack([np.where(np.arange(k) < rng.integers(0, k + 1), rng.permutation(m)[:k], -1) for _ in range(m)])
    part = neighbours.Part(np.arange(m), q, scale, (near, np.zeros((m, k), dtype=np.float32), q[near], scale[near]))
    lists = [rng.permutation(m)[: rng.integers(0, neighbours.REVERSE + 1)] for _ in range(m)]
    first, ids = np.concatenate(([0], np.cumsum([len(x) for x in lists]))), np.concatenate(lists)
    worst = np.where(rng.random(len(ids)) < 0.2, -np.inf, rng.normal(size=len(ids))).astype(np.float32)
    hosts = np.flatnonzero(np.diff(first))
    i, x, y, guest, other, value = neighbours._met(part, hosts, first, ids, worst, q[ids], scale[ids])
    there = i >= 0
    assert (x[there] == q[i[there]]).all() and (y[there] == scale[i[there]]).all()
    got = sorted(zip(guest // (len(i) // len(hosts)), i[guest], i[other], value, strict=True))
    want = []
    for h, u in enumerate(hosts.tolist()):
        a, b = first[u], first[u + 1]
        who = np.concatenate((ids[a:b], near[u][(near[u] >= 0) & ~np.isin(near[u], ids[a:b])]))
        g, o, v = neighbours._meet(who, q[who].astype(np.float32) * scale[who][:, None], np.arange(b - a), worst[a:b], neighbours.OFFERS)
        want += zip(np.full(len(g), h), who[g], who[o], v, strict=True)
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in sorted(want)], rel=1e-4, abs=1e-5)
