import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tesserae.llm import mixing, quality_classifier, tokens


def fixture():
    r = random.Random(8)
    good = [f"{a}{b}" for a in ("tion", "ing", "ther", "and", "ere", "oul") for b in ("s", "ly", "ed", "al", "")]
    docs, labels = [], []
    for i in range(400):
        lines = [" ".join(r.choice(good) + r.choice(["", "", str(r.randint(0, 99))]) for _ in range(r.randint(8, 20))) for _ in range(r.randint(1, 6))]
        y = i % 3 != 0
        text = "\n".join(lines) if y else "\n".join(" | ".join(x.split()) for x in lines)
        if i % 4 == 1:
            text += "\nShared line of many"
        docs.append([i, text, "en", r.choice(["a", "a", "a", "b", "c"]), 0])
        if r.random() < 0.8:
            labels.append((i, int(y), 0))
    for i in range(30):  # copies, exact and near
        words = docs[i * 7 + 1][1].split(" ")
        if i % 2:
            words[len(words) // 2] = "changed"
        docs.append([1000 + i, " ".join(words), "en", "b", 0])
    docs += [[2000, None, None, None, None], [2001, "", "en", "a", 0]]
    return [tuple(d[:4] + [len(d[1] or "")]) for d in docs], labels


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs, labels, model):
    rows = [d for d, p in zip(docs, quality_classifier.predict(model, [d[1] for d in docs])) if p >= 0.5]
    seen = defaultdict(set)
    for d in rows:
        for x in (d[1] or "").split("\n"):
            seen[x.strip(" \t\n\x0b\x0c\r").lower()].add(d[0])
    rows = [(d[0], "\n".join(x for x in (d[1] or "").split("\n") if not (k := x.strip(" \t\n\x0b\x0c\r").lower()) or len(seen[k]) < 10), *d[2:]) for d in rows]
    sets = {d[0]: shingles(d[1]) for d in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                ra, rb = find(a), find(b)
                up[max(ra, rb)] = min(ra, rb)
    return [d for d in rows if find(d[0]) == d[0]]


def test_pipeline(spark, tmp_path):
    docs, labels = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_classifier.fit(quality_classifier.sample(table, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    want = {d[0]: d for d in brute(docs, labels, model)}
    assert 150 < len(want) < 300
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "mixing", "packing"]
    now = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), table.schema)
        assert now.columns == table.columns
    order = now.collect()
    assert {d.doc_id: d.text for d in order} == {k: v[1] for k, v in want.items()}
    assert all(d.n_chars == len(d.text) for d in order)
    counts = Counter(d.source for d in order)
    keyed = {"n" if s is None else f"s{s}": n for s, n in counts.items()}
    slots = {(s, j): slot for s, j, slot, _, _ in mixing.plan(mixing.temperature(keyed), {s: -(-n // 16) for s, n in keyed.items()})}
    place, done = [], Counter()
    for d in order:
        s = "n" if d.source is None else f"s{d.source}"
        place.append(slots[s, done[s] // 16])
        done[s] += 1
    assert place == sorted(place)
    tok = tokens.encoder(tokens.default_path())._tok
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == want.keys()
    for k, rs in pieces.items():
        ids, at = np.array([*tok.encode(want[k][1], add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_sequences_follow_the_mixture(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "WINDOW", 32)
    docs, labels = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.sequence_id, r.offset))
    source = {d[0]: d[3] for d in docs}
    rows = spark.createDataFrame([(d, source[d]) for d in {r.doc_id for r in got}], "doc_id long, source string")
    order = [r.doc_id for r in mixing.mix(rows).orderBy("position").collect()]
    for w in range(len(order) // 32 + 1):
        assert {r.doc_id for r in got if r.sequence_id < (w + 1) << 32} == set(order[: 32 * (w + 1)])
    weights = mixing.temperature(Counter(source[d] for d in order))
    for w in range(1, 5):  # before a source is used up, all but a block of each share, and the open block
        done = Counter(source[r.doc_id] for r in got if r.sequence_id < w << 32 and r.start == 0)
        assert all(abs(done[s] - 32 * w * weights[s] / sum(weights.values())) <= 2 * 16 for s in weights)
    ends = Counter()
    for r in got:
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096


def test_stages_on_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name_and_odd_rows(spark, tmp_path):
    docs, labels = fixture()
    docs = [*docs[:120], (3, *docs[3][1:]), (3, *docs[3][1:]), (None, docs[4][1], "en", None, 1), (5000, "tionly inged " * 60_000, "en", "b", 0), (5001, None, None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ("position", "slot", "block", "score", "predicted", "n_lines", "n_dropped", "_id", "_key", "_src", "n", "component_id", "release")
    now = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"cast({i} as int) `{c}`" for i, c in enumerate(names))).repartition(3)
    schema = now.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in schema], name
        rows = out.collect()
        assert rows and all([r[c] for c in names] == list(range(len(names))) for r in rows), name
        now = spark.createDataFrame(rows, schema)
    kept = Counter(r.doc_id for r in rows)
    assert kept[3] in (0, 3) and kept[None] <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == kept
