"""Dealing, lifetimes of tables, long texts, and what empty tables look like."""

import collections
import os
import random
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veilcheck.functions.shipping import scratch_dir
from veilcheck.llm import chat, common, jaccard, language, mixing, neighbours, packing, quality, substrings, suffixes, urls

rng = random.Random(9)


@pytest.mark.parametrize("tasks,each,groups", [(20, 30, 50), (1, 1000, 7), (300, 5, 40), (7, 999, 64), (50, 64, 3), (211, 1, 30)])
def test_pieces_are_dealt_evenly(spark, tasks, each, groups):
    rows = spark.range(tasks * each).select((F.col("id") / each).cast("int").alias("task"), (F.col("id") % each).alias("turn"))
    n = collections.Counter(r.g for r in rows.select(packing.group_of(F.col("task"), F.col("turn"), groups).alias("g")).collect())
    assert set(n) <= set(range(groups)) and len(n) == groups and max(n.values()) <= 2 * tasks * each / groups


def test_more_groups_than_pieces_a_task(spark):
    """Repeated rows and long documents among them: groups follow pieces, not documents."""
    texts = ["one two three " * rng.randint(1, 60) for _ in range(150)] + ["same text"] * 200 + ["w " * 6000] * 5 + [None] * 20
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    got = packing.pack_documents(frame, most=64, group_pieces=40).collect()
    groups = collections.Counter(r.sequence_id >> 32 for r in got)
    assert len(groups) == -(-len(got) // 40) and max(groups.values()) <= 2 * len(got) / len(groups)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(r.length for r in got) // 64) * 1.1 + len(groups)


def test_a_tokenizer_is_known_by_its_settings(tmp_path):
    """A file of any name and other settings goes to the tokenizer itself; the same under another name does not."""
    from tokenizers import Tokenizer, normalizers

    path = packing.default_tokenizer()
    other = Tokenizer.from_file(path)
    other.normalizer = normalizers.NFC()
    other.save(str(tmp_path / "word_bpe_other.json"))
    os.symlink(path, tmp_path / "renamed.json")
    assert packing.Ids(path).by_piece and packing.Ids(str(tmp_path / "renamed.json")).by_piece
    ids = packing.Ids(str(tmp_path / "word_bpe_other.json"))
    assert not ids.by_piece
    data = np.frombuffer("Some Words, ABC".encode(), np.uint8)
    assert ids.of(data, np.array([0, len(data)]))[0].tolist() == other.encode("Some Words, ABC", add_special_tokens=False).ids


def test_chats_by_small_batches(spark):
    """Conversations that go over many batches, tasks and segments give what they give at once."""
    rows = []
    for c in [*range(30), None]:
        for t in range(rng.choice([1, 2, 3, 9, 40])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["system", "user", "assistant", "tool", None, "Human"]), rng.choice(["<|x", None, "", "a\nb", "same"])))
    rows += [(7, 3, "user", "same")] * 5
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(map(str, chat.format_chats(frame.coalesce(1)).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, segment, parts in ((1, 4096, "4"), (3, 5, "8"), (7, 1, "3"), (10_000, 2, "1")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(map(str, chat.format_chats(frame.repartition(3), segment_turns=segment).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_folder_of_one_machine_on_a_cluster():
    def session(master, **conf):
        held = dict(conf)
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=held.get, set=held.__setitem__), sparkContext=types.SimpleNamespace(master=master))

    for master in ("spark://h:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch_dir(session(master))
        assert scratch_dir(session(master, **{"spark.checkpoint.dir": "s3://b/c"})) == "s3://b/c"
    for master in ("local", "local[4]", "local[*]"):
        assert scratch_dir(session(master)).startswith("file:/")


def test_tables_go_with_their_readers(spark):
    def there(frame):
        return [p for f in frame.inputFiles() for p in [f.removeprefix("file://")] if os.path.exists(p)]

    steps = []

    def make():
        steps.append(common.settled(spark.range(9).toDF("a"), "step"))
        steps.append(common.finished(lambda: common.settled(steps[0].where("a > 3"), "inner"), "middle"))
        return steps[1].selectExpr("a * 2 AS a")

    out = common.finished(make, "out")
    assert sorted(r.a for r in out.collect()) == [8, 10, 12, 14, 16] and there(out)
    assert not any(map(there, steps))


WORDS = [f"v{i}" for i in range(5000)]
LONG = " ".join(rng.choice(WORDS) for _ in range(260_000))
OTHER = " ".join(rng.choice(WORDS) for _ in range(250_000))


def test_texts_longer_than_a_slice(spark):
    """Documents of over 1 MB: a copy, a near copy, one of its own, and one long run of one letter."""
    near = LONG.replace("v77 ", "x77 ")
    rows = [(0, LONG), (1, LONG), (2, near), (3, OTHER), (4, "a" * 1_300_000), (5, "short text"), (6, None)]
    assert min(len(t) for _, t in rows[:5]) > 1 << 20
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("aa")).withColumn("source", F.lit("s")).repartition(4)
    sub = {r.doc_id: r for r in substrings.remove_repeats(frame).collect()}
    assert [sub[i].n_words for i in range(7)] == [260_000, 260_000, 260_000, 250_000, 1, 2, 0]
    assert sub[0].n_removed == sub[1].n_removed == 260_000 and 0.9 * 260_000 < sub[2].n_removed < 260_000 and [sub[i].n_removed for i in (3, 4, 5, 6)] == [0] * 4
    cut = {r.doc_id: r for r in suffixes.remove_repeats(frame).collect()}
    assert cut[0].n_removed == cut[0].n_bytes == len(LONG) and cut[0].n_spans == 1 and cut[4].n_removed == 1_300_000 and cut[3].n_removed == cut[5].n_removed == 0
    assert 0.5 * len(near) < cut[2].n_removed < len(near) and cut[2].n_spans > 10
    same = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert [same[i][1] for i in range(7)] == [0, 0, 0, 3, 4, 5, 6] and same[4] == (1, 4) and same[6] == (0, 6)
    assert {r.doc_id: r.size for r in mixing.mixture(frame).collect()} == {i: len(brute.words(t)) for i, t in rows}
    assert {r.doc_id: r.lang_pred for r in language.identify(frame).collect()} == {i: "und" if t is None else "aa" for i, t in rows}
    judged = {r.doc_id: r for r in quality.judge(frame, spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")).collect()}
    assert judged[3].n_words == 250_000 and judged[4].word_chars == 1_300_000 and judged[4].base_failed
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    packed = collections.Counter()
    for r in packing.pack_documents(frame.where("doc_id in (0, 3, 6)")).collect():
        packed[r.doc_id] += r.length
    assert packed == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows if i in (0, 3, 6)}
    turns = spark.createDataFrame([(0, 0, "user", LONG), (0, 1, "assistant", OTHER)], "conv_id long, turn long, role string, text string")
    assert sorted(len(r.rendered) for r in chat.format_chats(turns).collect())[-2:] == sorted(len(t) + len(h) for t, h in ((LONG, "<|im_start|>user\n"), (OTHER, "<|im_end|>\n<|im_start|>assistant\n")))


def test_empty_tables_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "some text of a document", "aa", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    vectors = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for make, frame in (
        (mixing.mixture, docs), (mixing.mix, docs), (language.predict_held_out, docs), (language.keep_identified, docs), (lambda d: quality.judge(d, labels), docs), (substrings.remove_repeats, docs),
        (suffixes.remove_repeats, docs), (jaccard.near_duplicates, docs), (jaccard.keep_one, docs), (packing.pack_documents, docs), (chat.format_chats, turns),
        (lambda d: urls.judge_urls(d, urls.fed(d)), pages), (lambda d: neighbours.search(d, F.lit(True)), vectors),
    ):
        none = make(frame.where("false"))
        assert none.collect() == [] and [(f.name, f.dataType) for f in none.schema] == [(f.name, f.dataType) for f in make(frame).schema]
