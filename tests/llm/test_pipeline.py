"""The pipeline on a small corpus, each stage held to what it must do."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choices(["the", "ing", "re", "an", "on", "er"], k=rng.randrange(1, 4))) for _ in range(n))
    passage = prose(30)
    rows = [(i, prose(rng.randrange(30, 120)), "en", f"s{i % 4}") for i in range(120)]
    rows += [(200, rows[3][1], "en", "s1"), (201, rows[4][1] + " more", "en", "s1"), (202, passage + " tail", "en", "s0"), (203, None, "en", "s0"), (204, "12 34", "en", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got, kept = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, got, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        got = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept.append({r.doc_id for r in got.select("doc_id").collect()})
    assert kept[0] == {r[0] for r in rows} - {203, 204}
    assert kept[1] == kept[0] - {200, 201}
    assert kept[2] == kept[1] - {202}
    assert kept[3] <= kept[2]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == kept[3] and len(final) == got.count()
    ordered = sorted(final, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in final)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))


def test_run_against_brute_force(spark, tmp_path):
    """Every stage anew in plain Python: predictions one by one, all pairs, all windows, a sorted mix, the library's ids."""
    import hashlib
    import math
    import zlib

    import test_decontaminate
    import test_jaccard_join
    import test_mixing
    import test_token_blocks

    from factgraph.llm import language

    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices(["the", "ing", "re", "an", "on", "er"], k=rng.randrange(1, 4))) for _ in range(n))
    passage = prose(25)
    rows = [(i, prose(rng.randrange(20, 90)), f"s{i % 4}" if i % 9 else None) for i in range(90)]
    for i in range(90, 130):
        w = rows[i % 30][1].split()
        for k in rng.sample(range(len(w)), rng.randrange(0, 3)):
            w[k] = "changed"
        rows.append((i, " ".join(w), "s1"))
    rows += [(130, passage + " " + prose(30), "s2"), (131, prose(600) + " " + passage, "s2"), (132, None, "s0"), (133, "½ 12", "s0"), (134, "", None)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    network = language.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    told = [network.predict([t])[0] for _, t, _ in rows]
    left = [r for r, (lang, score) in zip(rows, told, strict=True) if lang != "und" and score >= 0.3]
    groups = test_jaccard_join.brute([r[:2] for r in left], 5, 80, 100)
    left = [r for r in left if groups[r[0]][1] == r[0]]
    hits = {d: test_decontaminate.brute(t, [(1, passage)], 13) for d, t, _ in left}
    left = [r for r in left if not (hits[r[0]][1] and 20 * hits[r[0]][1] >= hits[r[0]][0])]
    sizes: dict = {}
    for _, t, s in left:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets, mixed = test_mixing.filled(sizes), []
    for s in sizes:
        whole, rest, end = math.floor(targets[s] / sizes[s]), 0.0, 0
        rest = targets[s] - whole * sizes[s]
        keyed = []
        for d, t, _ in (r for r in left if r[2] == s):
            n = len(t.split())
            u = (int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            keyed.append((-math.log(u) * (1 + abs(len(t) / n - 6) / 6), d, n, t))
        for _, d, n, t in sorted(keyed):
            end += n
            more = end <= rest or (end - n < rest and end - rest <= rest - (end - n))
            mixed += [(d, t)] * (whole + more)
    want = sorted(test_token_blocks.brute(mixed), key=lambda r: r[1])
    got = sorted((tuple(r)[:4] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == want and len({r[0] for r in want}) > 60 and len(want) > len({r[0] for r in want})


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, lang_score int, times int, component_id string, `a.b` int"
    rows = [(i, "some plain words here " * (i + 1), "en", "s", 5, "x", 1, 2, "y", 3) for i in range(30)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            out = stage(spark, docs, str(tmp_path))
            assert out.schema.simpleString() == docs.schema.simpleString()
            out.write.parquet(str(tmp_path / f"{len(data)}-{i}"))
            docs = spark.read.schema(out.schema).parquet(str(tmp_path / f"{len(data)}-{i}"))
        assert corpus_pipeline.token_blocks(spark, docs, str(tmp_path)).count() == docs.count() and bool(data) == bool(docs.count())
