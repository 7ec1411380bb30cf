"""The corpus pipeline as a whole against plain Python, stage by stage and end to end."""

import collections
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from obsgrain.llm import bpe, nearcopies
from obsgrain.llm.common import texts
from test_llm import brute_classes, brute_exact, brute_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, __id string, __spot string, __file string, __of_edge string, _metadata string, key string, kept string, label string"


def said(rng, words, n):
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Copies, near copies, junk, nulls, rows without an id and repeated rows, and columns whose names clash with inner ones."""
    rng = np.random.default_rng(0)
    words = {"xx": [f"sch{a}ung" for a in "abcdefghijkl"], "yy": [f"ci{a}ado" for a in "abcdefghijkl"]}
    rows = []
    for k in range(120):
        lang = "xx" if k % 3 else "yy"
        rows.append([k, said(rng, words[lang], int(rng.integers(30, 120))), lang if k % 5 else None, "hot" if k % 3 == 0 else f"s{k % 4}"])
    for k in range(25):  # exact copies, with other white space
        rows.append([200 + k, rows[k % 4][1].replace(" ", "  " if k % 2 else "\n"), None, "hot"])
    for k in range(12):  # near copies: one word of a long text changed
        w = (rows[50][1] + " " + rows[51][1] + " " + rows[52][1]).split()
        w[5 + 7 * k] = f"changed{k}"
        rows.append([300 + k, " ".join(w), "xx", "s1"])
    rows += [[400, None, None, None], [401, "", "xx", "s1"], [402, " \n ", None, None], [403, "123 !!! 456", "yy", "hot"], [None, "no id at all but some words", "xx", "s2"], [404, "b", None, None], [405, "B", "yy", "s0"], list(rows[7]), list(rows[7])]
    path = tmp_path_factory.mktemp("corpus")
    d = spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * 9) for r in rows], SCHEMA).repartition(4)
    d.write.parquet(f"{path}/documents.parquet")
    return str(path), [tuple(r) for r in rows]


def brute_language(rows):
    return [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]


def brute_equal(rows):
    keep = {(i, n): None for i, n in brute_exact(rows).values()}
    out, seen = [], set()
    for r in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)):
        bare = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        if bare not in seen:
            seen.add(bare)
            out.append(r)
    assert len(out) == len(keep)
    return out


def brute_near(spark, rows):
    d = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    classes = brute_classes(rows, nearcopies.log_rarity(*nearcopies.frequencies(texts(d, "doc_id"))))
    return [r for r in rows if r[0] is None or classes[r[0]] == r[0]]


def brute_taken(rows):
    """Each row as often as its source's budget takes it: sources in the order of the documents' hashes up to the target."""
    total, target = brute_mix(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = []
    for s in total:
        whole = min(int(target[s] // total[s]), 3) if total[s] else 0
        rest, upto = target[s] - whole * total[s], 0
        spots = collections.defaultdict(list)
        for r in rows:
            if r[3] == s:
                name = "null:" + hashlib.md5((r[1] or "").encode()).hexdigest() if r[0] is None else str(r[0])
                spots[hashlib.md5(f"0:{name}".encode()).hexdigest()[:12]].append(r)
        for spot in sorted(spots):
            own = sum(size(r[1]) for r in spots[spot])
            upto += own
            more = upto <= rest or (upto - own <= rest and upto - rest < rest - (upto - own))
            out += [r for r in spots[spot] for _ in range(whole + more)]
    return out


def table(df):
    return collections.Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect())


def test_every_stage_and_the_whole(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    brute = [brute_language, brute_equal, lambda r: brute_near(spark, r), brute_taken]
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], brute, strict=True):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        rows = plain(rows)
        assert table(out) == collections.Counter(rows), name
        assert rows
        at = f"{path}/{name}.parquet"
        out.write.parquet(at)
        docs = spark.read.parquet(at)
    enc = bpe.encoding(bpe.rank_file())
    want = collections.Counter((i, tuple(enc.encode_ordinary(t or "")), lang, source) for i, t, lang, source in rows)
    got = corpus_pipeline.run(spark, path).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["lang"], r["source"]) for r in got) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "mixture", "tokens"]


def test_an_empty_corpus(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_corpus_without_languages_or_ids(spark, tmp_path):
    d = spark.createDataFrame([(None, "some words here", None, None), (None, "some  words here", None, None), (None, "12", None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == 1 and out[0]["doc_id"] is None and out[0]["n_tokens"] > 0
