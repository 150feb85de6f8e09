import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from .test_line_copies import corpus as copied_corpus
from .test_line_copies import similar
from .test_toxicity import corpus


def test_stages_on_a_small_folder(spark, documents, tmp_path):
    rows = corpus(120)
    passage = "\n".join(f"shared line {i} of a passage that is long enough to matter" for i in range(10))
    texts = {i: t for i, t, _ in rows}
    texts[1] += "\n" + passage
    texts[2] += "\n" + passage + "\nend"
    texts[500] = texts[3]
    texts[502] = " ".join(texts[3].split()[1:])
    texts[501] = texts[5] + " write to bob@site.org"
    documents(sorted(texts.items())).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{k}-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            seen.append(docs.count())
            ids = {r["doc_id"] for r in docs.collect()}
            if name == "line_dedup":
                assert {500, 502} <= ids  # copies are left whole for the next stage
            if name == "near_duplicates":
                assert {3, 500, 502} & ids == {3}
            if name == "pii":
                assert not [r for r in docs.collect() if "@" in r["text"]]
                assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert seen[1] < seen[0]
    assert seen[4] == seen[3] < seen[2] <= seen[1]
    pieces = docs.collect()
    assert all(zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in pieces)  # sequences hold their tokens
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(whole) == key(docs)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, empty, tmp_path, name):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, str(tmp_path)).count() == 0


def lines_left(rows, group):
    """The texts that line dedup leaves, by the rule as it reads: ``rows`` are (doc_id, text), ``group`` has the smallest id of a document's near copies."""
    units, first = [], {}
    for i, text in rows:
        lines = text.split("\n")
        n = [len(re.findall("[^\x20\x09-\x0d]+", x)) for x in lines]
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        starts = [0] + [k for k in range(1, len(lines)) if ((h[k - 2] if k > 1 else 0) * 1_000_003 + h[k - 1] >> 7) % 2 == 0 or n[k - 1] >= 50 or n[k] >= 50]
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(lines)], strict=True)):
            units.append((i, "chunk", k, s, e, sum(n[s:e]), "\n".join(lines[s:e])))
        at = [k for k, w in enumerate(n) if w]
        for k, (s, e) in enumerate(zip(at, at[1:], strict=False)):
            units.append((i, "pair", k, s, e + 1, 1, "\n".join(lines[s : e + 1])))
    units = [u for u in units if u[5]]
    for i, kind, k, *_, text in units:
        mine = (group.get(i, i) != i, i, k)
        first[kind, text] = min(first.get((kind, text), mine), mine)
    again = {}
    for i, kind, k, s, e, w, text in units:
        _, d, k1 = first[kind, text]
        if not (d == i and (k == k1 or kind == "pair" and k == k1 + 1)) and not (d != i and i in group and group.get(d) == group[i]):
            again.setdefault((i, kind), []).append((k, s, e, w))
    gone = {}
    for (i, _), found in again.items():
        runs = {}
        for n, (k, s, e, w) in enumerate(sorted(found)):
            runs.setdefault(k - n, []).append((s, e, w))
        for run in runs.values():
            if run[-1][1] - run[0][0] >= 2 or sum(r[2] for r in run) >= 50:
                gone.setdefault(i, set()).update(range(run[0][0], run[-1][1]))
    out = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}
    return {i: t for i, t in out.items() if i not in gone or t.strip()}


def test_stages_against_brute_force(spark, documents, tmp_path):
    rng = random.Random(2)
    texts, copies, _ = copied_corpus(6, originals=24)
    toxic = {100_000 + i: (t, y) for i, t, y in corpus(400)}
    for i in rng.sample(sorted(texts), 12):
        texts[i] += f"\nwrite to person{i}@site{i}.org soon"
    rows = sorted({**texts, **{i: t for i, (t, _) in toxic.items()}}.items())
    spark.createDataFrame([(i, 0, y) for i, (_, y) in toxic.items()] + [(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, stages = documents(rows), dict(corpus_pipeline.STAGES)

    def after(name):
        stages[name](spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    at = after("toxicity")
    kept = {r["doc_id"]: r["text"] for r in at.collect()}
    bad = {i for i, (_, y) in toxic.items() if y}
    assert set(dict(rows)) - set(kept) <= bad and len(bad & set(kept)) <= len(bad) // 4  # test_toxicity holds the fit against a plain one
    at = after("line_dedup")
    group = {i: o for i, o in copies.items() if similar(texts[i], texts[o])}
    group |= {o: o for o in group.values()}
    left = {r["doc_id"]: r["text"] for r in at.collect()}
    assert left == lines_left(sorted(kept.items()), group)
    at = after("near_duplicates")
    ids, root = sorted(left), {}
    for i in ids:
        root[i] = next((root[j] for j in ids if j < i and similar(left[i], left[j])), i)
    assert {r["doc_id"] for r in at.collect()} == {i for i in ids if root[i] == i}
    at = after("pii")
    clean = {r["doc_id"]: r["text"] for r in at.collect()}
    assert clean == {i: re.sub(r"person\d+@site\d+\.org", "<EMAIL>", t) for i, t in left.items() if root[i] == i}
    pieces = after("packing").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole, sequences = {}, {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["piece"])):
        whole.setdefault(r["doc_id"], []).extend(r["ids"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert whole == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in clean.items()}
    for spans in sequences.values():
        assert sorted(spans) == [(sum(n for _, n in sorted(spans)[:k]), n) for k, (_, n) in enumerate(sorted(spans))] and sum(n for _, n in spans) <= 1024
