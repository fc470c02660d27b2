"""The corpus pipeline on small hostile tables, stage by stage against plain Python, and as a chain."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from keystrata.llm import jaccard_join, line_dedup, packing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, copies int, removed int, _w string, _th string, size long, `a.b` string"


def documents():
    rng = random.Random(9)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(400))
    text = lambda n=80: "\n".join(" ".join(word() for _ in range(10)) for _ in range(n // 10))
    clean = [text() for _ in range(24)]
    near = clean[0].replace(clean[0].split()[40], "changed")
    texts = [*clean, clean[1], near, None, "", " \n\t", "too short", text(20_000), "spam " * 200, clean[2] + "\nAll rights reserved.", clean[3] + "\nAll rights reserved."]
    rows = [(i, t, "en", [None, "web", "book"][i % 3]) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, text(), "en", "web"), (7, text(), "en", "book")]  # repeated rows, a null id, two texts of one id
    return [(*r, len(r[1] or ""), 1, 2, "w", "th", 3, "dot") for r in rows]


def write(spark, folder, rows, labels=()):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def base_passes(text):
    w = WORD.findall(text or "")
    at = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if at[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w) >= 50 and 100 * len(inside) <= 50 * len(w)


def test_stages_on_hostile_rows(spark, tmp_path):
    rows = documents()
    docs = write(spark, tmp_path, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        # what a stage doesn't decide on passes through
        assert all(r["copies"] == 1 and r["removed"] == 2 and r["_w"] == "w" and r["_th"] == "th" and r["size"] == 3 and r["a.b"] == "dot" for r in after), name
        if name == "quality rules":
            assert Counter((r["doc_id"], r["text"]) for r in after) == Counter((r["doc_id"], r["text"]) for r in before if base_passes(r["text"]))
        elif name == "line dedup":
            seen, want = set(), Counter()
            for (i, t), n in sorted(Counter((r["doc_id"], r["text"]) for r in before).items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
                lines = t.split("\n")
                if i == 7:  # which of one id's texts comes first is settled by a hash; they share no line
                    seen.update(lines)
                    want[i] += n
                    continue
                left = [x for x in lines if x not in seen]
                seen.update(lines)
                want[i] += n * bool("".join(left).strip())
            got = Counter(r["doc_id"] for r in after)
            assert got[24] == 0 and got[None] == 1 and "All rights reserved." in {x for r in after for x in r["text"].split("\n")}
            assert {k: v for k, v in got.items() if k != 25} == {k: v for k, v in want.items() if v and k != 25}
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "n-gram Jaccard join":
            assert Counter(r["doc_id"] for r in after)[5] == 1 and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        else:
            assert {r["text"] for r in after} <= {r["text"] for r in before}
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert len(packing.encoder(packing.default_tokenizer())("a b")) >= 2


def test_run_is_the_chain(spark, tmp_path):
    write(spark, tmp_path, documents(), [(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("stage", [lambda d, x: quality_rules.kept_documents(d, x), lambda d, x: line_dedup.deduped(d), lambda d, x: jaccard_join.one_of_each(d)])
def test_filters_keep_clean_documents(spark, stage):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(90))) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, stage(d, labels).collect())) == rows
