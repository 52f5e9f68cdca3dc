import zlib

import numpy as np
import public_tokenizers
from test_disclosure import EMAIL
from test_lsh_forest import brute as near_brute
from test_suffix_dedup import brute as repeat_brute
from tokenizers import Tokenizer

import corpus_pipeline
from shapecast.llm.fit_packing import pack


def corpus():
    from test_kneser_ney import corpus as words
    rows, labels = words()
    rows = [(i, t + f" tail{i} of{i} this{i} one{i} is{i} new{i}", x) for i, t, x in rows]
    rows += [(1000 + k, rows[1][1] + f" end{k // 2}", "fr") for k in range(12)]
    rows += [(2000, rows[2][1][:60] + " write to some.one@mail.example.org now " + rows[2][1][70:130], "fr"), (3000, None, "en"), (3001, "", None)]
    return rows, labels


def test_stages(spark, docs_of, folder_of):
    rows, labels = corpus()
    sf = folder_of(documents=docs_of(rows, "extra"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == columns, name
        texts.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.count() == len(texts[-1])
    good, one, cut, clean = texts
    assert {i for i, t, _ in rows if t and i < 1000 and i % 4} <= set(good) | {1} and not {i for i, _, _ in rows if i < 1000 and i % 4 == 0} & set(good)
    assert 3000 not in good and 3001 not in good
    left = [(i, t) for i, t in good.items()]
    assert set(one) == {c for _, c, _, _ in near_brute(left)}
    want = {r[0]: r[2] for r in repeat_brute(list(one.items()))}
    assert {i: len(one[i].encode()) - len(cut[i].encode()) for i in one} == want
    assert all(not EMAIL.search(t) for t in clean.values()) and set(clean) == set(cut)
    assert all(clean[i] == t for i, t in cut.items() if not EMAIL.search(t))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = {(r.doc_id, r.piece): r.ids_crc32 for r in corpus_pipeline.packing(spark, docs, sf).collect()}
    assert packed == {(i, 0): zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in clean.items()}
    assert sorted((r.doc_id, r.length) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(
        (r.doc_id, r.length) for r in pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect())


def test_empty(spark, docs_of, folder_of):
    sf = folder_of(documents=docs_of([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, sf).count() == 0
