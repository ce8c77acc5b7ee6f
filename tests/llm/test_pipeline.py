import random

import sentencepiece

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks_of
from tests.llm.test_ngram_join import brute as components_of
from wordloom.llm.langid import keep_identified
from wordloom.llm.pii import redact_texts
from wordloom.llm.sp_codec import codec, default_model


def test_stages(spark, tmp_path):
    r = random.Random(3)
    words = {"en": "the of and to in that is was for it with as his on be at by had not are but from".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "", r.choice(words[lang])]) for _ in range(n))
    docs = [(i, text(lang, 60), lang, "s", 0) for i, lang in enumerate(["en", "de"] * 20)]
    item = text("en", 30)
    docs += [
        (100, docs[3][1], "de", "s", 0),  # a copy
        (101, docs[4][1] + " the end", "en", "s", 0),  # a near copy
        (102, text("en", 20) + " " + item + " " + text("en", 20), "en", "s", 0),  # a leak
        (103, text("en", 40) + " me@x.org " + text("en", 9), "en", "s", 0),
        (104, None, "en", "s", 0), (105, "12 % 3", "en", "s", 0), (106, "", None, "s", 0),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, want = frame, {d[0] for d in docs}
    gone = {"language": {104, 105, 106}, "near_copies": {100, 101}, "decontamination": {102}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == frame.columns
        rows = {r.doc_id: r for r in out.collect()}
        want = want - gone.get(name, set())
        assert set(rows) == want, name
        now = spark.createDataFrame(list(rows.values()), frame.schema)
    assert "<EMAIL>" in rows[103].text and rows[103].n_chars == len(rows[103].text) and rows[0].text == docs[0][1]
    end = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    own = codec(default_model())
    assert {i: r.pieces for i, r in end.items()} == {i: own.encode(r.text) for i, r in rows.items()}


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_five_words(spark):
    """79 of 96 five-word shingles are shared (0.82), of four words 80 of 97 (under 0.85)."""
    words = [f"w{i}" for i in range(100)]
    docs = [(0, " ".join(words)), (1, " ".join(words[:83])), (2, " ".join(words[:70]))]
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in out.collect()} == {0}


def test_run_against_brute_force(spark, tmp_path):
    """What the stages keep of documents with near copies, leaks, personal data, repeated ids and
    columns of clashing names: all pairs of sets, all windows of all texts, the model's library."""
    r = random.Random(9)
    parts = {"en": "the of and in that is was for with his but from".split(), "fr": "le la les des une dans pour que qui sur est pas".split()}
    text = lambda lang, n: " ".join(r.choice(parts[lang]) + r.choice(parts[lang]) for _ in range(n))
    items = [(i, text("en", r.choice([20, 40]))) for i in range(4)]
    docs = []
    for i in range(60):
        lang = r.choice(["en", "fr"])
        words = text(lang, r.choice([3, 40, 90])).split()
        if docs and r.random() < 0.4:
            words = r.choice(docs)[1].split()
            for _ in range(r.choice([0, 1, 2, 6])):
                words[r.randrange(len(words))] = "changed"
        if r.random() < 0.2:
            words[1:1] = r.choice(items)[1].split()
        if r.random() < 0.2:
            words.append(r.choice(["me@x.org", "10.1.2.3", "+49 30 1234567"]))
        docs.append((i, " ".join(words), lang, "s", 0, None))
    docs += [(i, t, lang, "s", 1, "x") for i, t, lang, *_ in docs[:3]]  # ids and texts again
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, cls string")
    frame.coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = {x.doc_id for x in keep_identified(frame).collect()}  # held against all segmentations elsewhere
    rows = {i: t for i, t, *_ in docs if i in known}
    linked = components_of(list(rows.items()), words=5, percent=80)
    rows = {i: t for i, t in rows.items() if linked[i][1] == i}
    leaked = {i for i, _ in leaks_of(list(rows.items()), items)}
    rows = {i: t for i, t in rows.items() if i not in leaked}
    redacted = {x.doc_id: x.text for x in redact_texts(frame).collect()}  # its base spans are held against patterns elsewhere
    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = {i: model.encode(redacted[i]) for i in rows}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(known) < 63 and leaked and len(got) == len(want)
    assert {x.doc_id: x.pieces for x in got} == want and all(x.round_trip for x in got)
