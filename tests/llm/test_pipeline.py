import random
import sys
import zlib
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import numpy as np
from plain import ALNUM, components, contamination, fold, quality

import corpus_pipeline
from ledgerleaf.llm import packing
from ledgerleaf.llm.queries import ORACLES, QUERIES


def plain_dedup(docs):
    """Runs of 50 words or more that an earlier document has, line for line, go from later ones."""
    seen, out = set(), []
    for d, t in sorted(docs):
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[i:j]) >= 50 and tuple(lines[i:j]) in seen:
                    gone |= set(range(i, j))
        seen |= {tuple(lines[i:j]) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)}
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if left.strip() or not gone:
            out.append((d, left))
    return out


def plain_clean(docs, items):
    out = []
    for (d, t), (_, n, hit, *_) in zip(docs, contamination(docs, items)):
        if 2 * hit >= n > 0:
            continue
        if hit:  # the only planted passage, as it stands in the text
            passage = items[0][1]
            assert fold(passage) in fold(t)
            at = fold(t).index(fold(passage))
            t = t[:at] + t[at + len(passage) :]
        out.append((d, t))
    return out


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 8))) for _ in range(500)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, item = [line(30), line(40)], line(16)
    docs = [(i, "\n".join([line(60), line(20)])) for i in range(30)]
    docs += [(100 + i, "\n".join([line(55), *passage, line(9)])) for i in range(6)]  # a shared passage
    docs += [(200 + i, docs[i][1]) for i in range(4)]  # exact copies
    docs += [(300 + i, docs[i][1].replace("\n", " ") + " more words") for i in range(4, 8)]  # near copies
    docs += [(400 + i, f"{line(40)} {item} {line(40)}") for i in range(3)] + [(410, f"{item} {line(12)} {item.upper()} {line(10)}")]
    docs += [(500, "short"), (501, None), (502, ""), (503, "same words again " * 40), (504, " ".join(f"{w}###" for w in vocabulary[:80]))]
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(d, t) for d, t in docs if not quality(t)[5] and "###" not in t]
    kept = plain_dedup(kept)
    top = components(kept, 5, 80, 100)
    kept = [(d, t) for d, t in kept if top[d][1] == d]
    kept = plain_clean(kept, [(1, item)])
    assert {200, 304, 410, 503} & {d for d, _ in kept} == set()

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = packing.ChunkEncoder(packing.tokenizer_path(), 2)
    ids = {d: np.frombuffer(enc.encode([t])[0], "<u4") for d, t in kept}
    assert {r.doc_id for r in got} == set(ids)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    assert not any(ALNUM.search(t) and fold(item) in fold(t) for _, t in kept)


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "word " * 3, "en", None, 15), (None, None, None, None, None)], schema)
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        stage(spark, docs.limit(0), str(tmp_path)).collect()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
