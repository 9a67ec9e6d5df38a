import bisect
import collections
import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veilcheck.llm import chat, components, jaccard, kernels, language, mixing, neighbours, packing, quality, substrings, suffixes, urls

rng = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(60)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(50)
BASE = prose(90)
TEXTS = [
    None, "", "  \n\t ", "one", "One  two\nthree", "one two three", prose(80), prose(300), prose(40) + " " + PASSAGE + " " + prose(33), PASSAGE, prose(10) + "\n" + PASSAGE + "\n" + prose(60) + " " + PASSAGE,
    BASE, BASE, BASE.upper(), BASE.replace("w7", "x7"), BASE + " end", "a " * 120, "b" * 900, "\u00e9" * 300, prose(34), "\u65e5\u672c\u8a9e " * 60, PASSAGE.replace(" ", "\u00a0"),
    "x\u00a0y " * 30, prose(3000), prose(35),
]
ROWS = [*enumerate(TEXTS), (None, TEXTS[6]), (None, None), (3, "one"), (3, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    clashing = ("k", "part", "kind", "body", "id", "s", "n", "label", "size", "row", "score", "lang", "source", "target", "piece")
    return frame.select("doc_id", "text", *(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("v"), (F.col("doc_id") % 4).cast("string"))).alias(c) for c in clashing))


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("width", [35, 12, 5, 1])
def test_substrings(docs, width):
    assert rows_of(substrings.remove_repeats(docs, width=width)) == brute.substrings(ROWS, width)


def test_substrings_keep_text(docs):
    kept = {r.doc_id: r for r in substrings.remove_repeats(docs, width=35, keep_text=True).collect()}
    assert kept[6].kept is not None and kept[9].kept == "" and PASSAGE not in kept[8].kept
    assert kept[4].kept == TEXTS[4] and brute.words(kept[8].kept) == brute.words(TEXTS[8])[:40] + brute.words(TEXTS[8])[90:]


def test_covers():
    for v, cover in substrings.COVERS.items():
        assert {(a - b) % v for a, b in itertools.product(cover, cover)} == set(range(v))


@pytest.mark.parametrize("width", [200, 40, 3])
def test_suffixes(docs, width):
    assert rows_of(suffixes.remove_repeats(docs, width=width)) == brute.suffixes(ROWS, width)


@pytest.mark.parametrize("width", [3, 8, 20, 64, 200])
def test_suffix_arrays(width):
    gen = np.random.default_rng(width)
    text = gen.integers(0, 2, 3000).astype(np.uint8) * 255
    text[1000:1700] = text[200:900]
    text[2000:2300] = 7
    starts = gen.permutation(len(text) - width)
    order, new = suffixes.suffix_array(suffixes.Texts(text, width), starts)
    raw = text.tobytes()
    found = [raw[s : s + width] for s in starts[order]]
    assert found == sorted(found) and new.tolist() == [i == 0 or found[i] != found[i - 1] for i in range(len(found))]


@pytest.mark.parametrize("width", [4, 70])
def test_levels_merge_geometrically(width):
    gen = np.random.default_rng(2)
    index, texts = suffixes.Levels(width), []
    for i in range(16):
        text = gen.integers(97, 99, 100 + width).astype(np.uint8)
        if i % 3 == 1:
            text[: 60 + width] = texts[i // 2][10 : 70 + width]
        texts.append(text)
        index.add(text, np.arange(100))
        sizes = [len(level.starts) for level in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    every = [t.tobytes()[s : s + width] for t in texts for s in range(100)]
    n = collections.Counter(every)
    assert index.marks().tolist() == [n[v] > 1 for v in every]
    held = [level.texts.data.tobytes()[s : s + width] for level in index.levels for s in level.starts]
    assert set(held) == set(every) and len(index.levels) <= 5


@pytest.mark.parametrize("size,percent", [(5, 75), (2, 60), (1, 90)])
def test_jaccard(docs, size, percent):
    assert rows_of(jaccard.near_duplicates(docs, size=size, percent=percent)) == brute.jaccard(ROWS, size, percent)


def test_jaccard_crowd(spark):
    """A group of near copies beyond FEW, some linked by others only, and passages that many share."""
    words = prose(120).split()
    rows = []
    for i in range(140):
        w = list(words)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w[: rng.choice([120, 118, 100])])))
    rows += [(200 + i, prose(60) + " " + " ".join(words[:25]) + " " + prose(20)) for i in range(60)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert rows_of(got) == brute.jaccard(rows, 5, 75)


def test_jaccard_crowd_of_lengths(spark, monkeypatch):
    """Classes of one n-gram in several parts and bins of lengths, some similar enough and some not."""
    monkeypatch.setattr(jaccard, "CROWD", 8)
    monkeypatch.setattr(jaccard, "STARS", 1)
    monkeypatch.setattr(jaccard, "HUBS", 1)
    words, rows = prose(300).split(), []
    for i in range(150):
        n = rng.choice([60, 66, 75, 79, 80, 81, 100, 120, 160, 300])
        w = words[:n]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for percent in (75, 90):
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=percent)
        assert rows_of(got) == brute.jaccard(rows, 5, percent)


def test_templated_pages_make_no_pairs(spark):
    """Pages that share 80 % of their words but do not link meet on no n-gram of the indexed side."""
    shared = " ".join(f"t{i}" for i in range(11))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared + " "), F.concat_ws(" ", *(F.concat(F.lit(f"u{j}x"), F.col("id").cast("string")) for j in range(3)))).alias("text"))
    got = jaccard.near_duplicates(docs)
    assert got.where("n_shingles = 10 and component_id = doc_id").count() == 20_000


def test_keep_one(docs):
    kept = jaccard.keep_one(docs)
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and ids[11] == 1 and ids[3] == 1 and not ids[12] and not ids[13] and ids[0] == ids[1] == ids[2] == 1 and ids[None] == 1


def test_components(spark):
    edges = [(rng.randint(-90, 90), rng.randint(-90, 90)) for _ in range(80)] + [(i, i + 1) for i in range(200, 230)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in parent if find(x) != x)
    frame = spark.createDataFrame(edges, "a long, b long")
    for one_task in (10**6, 0):
        assert sorted(map(tuple, components.components(frame, one_task).collect())) == want


def test_signals(docs, spark):
    extra = [(90, "\n\na b c\na b c\n\u00e9 ## x\n a b c\n"), (91, "a\na\r\na\n\n \n \n"), (92, "#<>|&%$*!")]
    frame = spark.createDataFrame([*ROWS, *extra], "doc_id long, text string")
    labels = spark.createDataFrame([(6, 1, "x"), (7, 0, "y"), (None, 1, "z"), (5, None, "w"), (8, 1, "v")], "doc_id long, quality int, text string")
    for some in (labels, labels.where("false")):
        got = quality.judge(frame, some).collect()
        assert sorted(str((r.doc_id, *tuple(r)[1:6])) for r in got) == sorted(str((i, *brute.signals(t))) for i, t in [*ROWS, *extra])
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_learns(spark):
    good = [(i, prose(70), 1) for i in range(150)]
    bad = [(200 + i, " ".join(w + "##" for w in prose(70).split()), 0) for i in range(150)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(frame.select("doc_id", "text"), frame.where("doc_id % 2 = 0").select("doc_id", "quality")).collect()}
    assert np.mean([got[i] == bool(q) for i, _, q in good + bad if i % 2]) > 0.95


def test_language(spark):
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opq\u00e9\u0436stu"}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(rng.randint(1, 40))), lang) for i in range(300) for lang in [rng.choice(list(letters))]]
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, "abc", None), (None, "hijk", "bb"), (904, "\u65e5\u672c", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language.predict_held_out(frame).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and by[904].lang_pred != "und"
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows if i is not None) and not by[None].held_out
    assert np.mean([by[i].lang_pred == lang for i, _, lang in rows[:300] if by[i].held_out]) > 0.97
    assert {r.lang_pred for r in language.predict_held_out(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language.keep_identified(frame)
    assert kept.columns == frame.columns and not {900, 901, 902} & {r.doc_id for r in kept.collect()}


def test_leader_is_sparse():
    model = language.Leader(10, 2)
    for _ in range(50):
        model.step(np.array([0, 1]), np.array([1.0, 0.01]), 0)
        model.step(np.array([2, 1]), np.array([1.0, 0.01]), 1)
    w = model.weights(slice(None))
    assert w[0, 0] > 0 > w[0, 1] and (w[3:] == 0).all() and np.abs(w[1]).max() < 0.05


def test_mixing(spark):
    sizes = {"a": 4000, "b": 50, "c": 900, None: 300, "z": 0}
    rows, i = [], 0
    for source, total in sizes.items():
        for n in [total // 40] * 40:
            rows.append((i, "w " * n, source))
            i += 1
    rows += [(None, None, "a"), (0, "w " * 100, "a"), (0, "w " * 100, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit(1))
    got = mixing.mixture(frame)
    again = rows_of(got)
    assert again == rows_of(mixing.mixture(frame.repartition(5)))
    # water-filling by repetition
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(brute.words(t))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, want, open_ = float(sum(size.values())), {}, set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] >= 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    source = {i: s for i, _, s in rows}
    for r in got.collect():
        s = source[r.doc_id] if r.doc_id is not None else "a"
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 10 for s in names)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r.times for r in got.collect())


def test_mixing_beyond_a_broadcast(spark, monkeypatch):
    rows = [(i % 50, f"w{i} " * (i % 7), f"s{i % 23}") for i in range(600)] + [(None, None, None)] * 4
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("times", F.lit("clash"))
    want, mixed = rows_of(mixing.mixture(frame)), rows_of(mixing.mix(frame.repartition(3)))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows_of(mixing.mixture(frame)) == want and rows_of(mixing.mix(frame.repartition(7))) == mixed


def test_jaccard_beyond_a_broadcast(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_KEYS", 0)
    assert rows_of(jaccard.near_duplicates(docs)) == brute.jaccard(ROWS, 5, 75)


def test_urls(spark):
    rows = ["http://A.Example.com/en/7?x", "https://example.com/en/71", "http://com/en/", "http://xcom/en/", "ftp://example.net/de/8", "http://b.net/de/", "x://org/es/#a", "x://org/es", "nope", None, "", "http://h.x/a/?utm_source=feed", "https://H.x/a.html", "http://h.x/b", "http://h.x", "http://h.x?utm_source=feed", "http://h.x/a/\n"]
    frame = spark.createDataFrame(list(enumerate(rows)) + [(11, rows[11])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(frame, urls.fed(frame)).collect()}
    assert [got[i][2:] for i in range(8)] == [("example.com/en/7", "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow")]
    assert got[0][:2] == ("a.example.com", "/en/7") and [got[i] for i in (8, 9, 10)] == [("", "", None, "allow")] * 3
    assert [got[i][3] for i in (11, 12, 13, 14, 15, 16)] == ["block", "block", "allow", "block", "block", "allow"]
    many = spark.range(20000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"))
    pages = spark.range(10000, 40000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"))
    assert {r.verdict: r["count"] for r in urls.judge_urls(pages, many).groupBy("verdict").count().collect()} == {"block": 10000, "allow": 20000}
    assert urls.judge_urls(pages, many.where("false")).where("verdict = 'block'").count() == 0


def test_neighbours(spark):
    gen = np.random.default_rng(4)
    x = gen.normal(size=(3000, 16)).astype(np.float32)
    x[50:250] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] + [1.0] * 15), (5005, [float("inf")] * 16), (5006, [1.0] * 3), (None, x[0].tolist()), (20, x[20].tolist())]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in neighbours.search(frame, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids = np.append(np.arange(3000), 20)
    y = np.vstack([x, x[20]]).astype(np.float64)
    hits = 0
    for q in range(0, 3000, 20):
        s = y @ y[q]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == sorted([*range(1, 21)] * (2 if q == 20 else 1)) and all(abs(m[2] - y[m[1]] @ y[q]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & set(ids[best].tolist())) / 20
    assert set(got) == set(range(0, 3000, 20)) and hits / 150 >= 0.9
    same = [v for _, v, _ in sorted(got[60]) if 50 <= v < 250]
    assert same[:5] == [50, 51, 52, 53, 54] and same == sorted(same)
    few = neighbours.search(frame.where("vec_id < 6"), F.col("vec_id") == 0).collect()
    assert len(few) == 5 and neighbours.search(frame.where("vec_id > 4999"), F.col("vec_id") > 0).count() == 0


def test_walk_goes_by_summed_distance():
    gen = np.random.default_rng(1)
    index = [gen.normal(size=(9, 4)), gen.normal(size=(7, 3))]
    q = gen.normal(size=7)
    cells = neighbours.walk(q, index, np.ones(63, np.int64), 40)
    total = (-(index[0] @ q[:4])[:, None] - (index[1] @ q[4:])[None]).ravel()
    assert np.allclose(total[cells], np.sort(total)[:40]) and len(set(cells)) == 40


def test_packing(spark, docs):
    extra = [(70, "It's <|endoftext|> \u00bd \u00c0\u00c9 don't\u2019s we'll'x  '' 12a3 \x1c a_b #$ \u00b3 \u00df\u0130 \u65e5\u672c"), (71, "don't 'tis 's's ''s x'"), (72, "s it'S \u00c9'LL we'rex 1've2 --'s"), (73, "\u00c0\u00c9\u00ce\u00de \u00d7a\u00f7b \u00df\u00ff"), (74, prose(9000)), (75, "\u00e91\u00e9,\u00e9 caf\u00e9'S na\u00efve--'s 'd5")]
    rows = ROWS + extra
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash"))
    got = packing.pack_documents(frame, most=512).collect()
    from tokenizers import Tokenizer

    tokenizer, want, total = Tokenizer.from_file(packing.default_tokenizer()), [], 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want += [(i, p, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())) for p, a in enumerate(range(0, len(ids), 512))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for s in places.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(s))]
        assert [a for a, _ in sorted(s)] == ends[:-1] and ends[-1] <= 512
    assert len(places) <= -(-total // 512) * 1.03 + 1


def test_best_fit_is_best_fit():
    lengths = np.random.default_rng(5).integers(1, 101, 400)
    sequence, offset = packing.best_fit(lengths, 100)
    room, used = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, -k) for k, r in enumerate(room) if r >= lengths[i]]
        left = min(fits)[0] if fits else 100
        assert 100 - offset[i] == left
        used[sequence[i]] = left - lengths[i]
        room = list(used.values())


def cost_of(roles):
    known, best = [chat.known(r) for r in roles], 10**9
    for labels in itertools.product((1, 2, 3), repeat=len(known)):
        cost, state = sum(0 if a == b else chat.RENAME if a == 0 else chat.RELABEL for a, b in zip(known, labels)), 0
        for new in labels:
            if new in chat._NEXT[state]:
                pass
            elif new == state:
                cost += chat.MERGE
            elif any(new in chat._NEXT[m] for m in chat._NEXT[state]):
                cost += chat.INSERT
            else:
                break
            state = new
        else:
            best = min(best, cost + int(chat.END[state]))
    return best


@pytest.mark.parametrize("segment", [4096, 2])
def test_chat(spark, segment):
    chats = [[rng.choice(["system", "user", "assistant", "tool", None, " Human"]) for _ in range(rng.randint(1, 6))] for _ in range(40)] + [["user"] * 6, ["system"], ["assistant"]]
    rows = [(i, t, r, f"<|t{t}") for i, c in enumerate(chats) for t, r in enumerate(c)] + [(None, 0, "user", None), (77, None, "user", "b"), (77, 1, "user", "a"), (78, 0, "user", "same"), (78, 0, "user", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    by = collections.defaultdict(list)
    for r in chat.format_chats(frame, segment_turns=segment).collect():
        by[r.conv_id].append(r)
    assert set(by) == {*range(len(chats)), None, 77, 78}
    for i, c in enumerate(chats):
        mine = sorted(by[i], key=lambda r: (r.turn, r.step))
        cost = sum(chat.INSERT if r.action == "insert" else 0 if r.action == "end" else (chat.MERGE if r.action == "merge" else 0) + (0 if chat.ROLES.index(r.role) + 1 == chat.known(c[r.turn]) else chat.RENAME if not chat.known(c[r.turn]) else chat.RELABEL) for r in mine)
        assert cost == cost_of(c)
        text = "".join(r.rendered for r in mine)
        roles = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
        assert text.count("<|im_end|>") == len(roles) and all(f"< |t{t}" in text for t in range(len(c)))
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for frame in (
        substrings.remove_repeats(none), suffixes.remove_repeats(none), jaccard.near_duplicates(none), jaccard.keep_one(none), language.predict_held_out(none), language.keep_identified(none),
        quality.judge(none, labels), mixing.mixture(none), mixing.mix(none), packing.pack_documents(none), chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
        urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), urls.fed(spark.createDataFrame([], "page_id long, url string"))),
        neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)),
    ):
        assert frame.count() == 0


def test_kernels_on_random_bytes():
    data = np.frombuffer("".join(rng.choice("ab \n\u00e9") for _ in range(400)).encode(), np.uint8)
    cuts = np.array([0, 0, 50, 51, 51, 200, len(data)])
    starts, ends, firsts = kernels.words(data, cuts)
    want = [[w for w in data[a:b].tobytes().split()] for a, b in zip(cuts, cuts[1:])]
    assert [[data[a:b].tobytes() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(firsts, firsts[1:])] == want
    values = kernels.mix(np.arange(30, dtype=np.uint64) % 3)
    for width in (1, 2, 5, 8, 13):
        one = kernels.windows(values, width)
        assert [one[i] == one[0] for i in range(len(one))] == [i % 3 == 0 for i in range(len(one))]


def test_suffix_index_takes_bounded_memory_beside_its_levels():
    rng, width = np.random.default_rng(5), 24

    def level(n):
        # one head for all, so that every suffix is sought by its text
        data = np.frombuffer(b"".join(b"the head" + x.tobytes() for x in rng.integers(97, 101, (n, 16)).astype(np.uint8)), np.uint8)
        texts, starts = suffixes.Texts(data, width), np.arange(n) * width
        order, new = suffixes.suffix_array(texts, starts)
        return suffixes.Level(texts, starts[order[new]], order[new])

    def peak(call):
        tracemalloc.start()
        try:
            return call(), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    a, b = level(2000), level(400_000)
    (place, equal), mb = peak(lambda: a.seek(b))
    assert mb < 50  # 139 when all suffixes were compared at once
    text = [[bytes(x.texts.data[i : i + width]) for i in x.starts] for x in (a, b)]
    assert text[0] == sorted(text[0]) and text[1] == sorted(text[1])
    assert place.tolist() == [bisect.bisect_left(text[0], t) for t in text[1]]
    known = set(text[0])
    assert equal.tolist() == [t in known for t in text[1]]
    both = a.merged(b, place, equal)
    assert [bytes(both.texts.data[i : i + width]) for i in both.starts] == sorted({*text[0], *text[1]})
    pieces, n = suffixes.Pieces(width), 1000
    one, other = (rng.integers(0, 256, n + width - 1).astype(np.uint8).tobytes() for _ in range(2))
    codes = pieces.add(other + one * 4000, np.full(4001, n, np.uint32))
    marks, mb = peak(lambda: pieces.marks(codes))
    assert mb < 30  # 64 when the places of all suffixes were made at once
    assert not marks[:n].any() and marks[n:].all() and len(marks) == 4001 * n
