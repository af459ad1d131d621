"""Operators across rows: near-duplicates, chats, URL lists, shards, the pipeline; brute force and edge cases."""

import datetime
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_text_operators import brute_contamination, brute_redacted

import corpus_pipeline
from wardenry.llm import chat, common, language_id, near_dedup, sharding, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string"


def brute_components(rows, size, percent):
    sets = {}
    for doc, text in rows:
        if doc is not None:
            w = (text or "").encode().translate(near_dedup._LOWER).split()
            sets.setdefault(doc, []).append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] != label[b] and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (None, "one"), (4, "a b"), (5, "a b")]
    for base in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(7):
            own = list(words)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(60)] = f"x{rng.randrange(9)}"
            rows.append((len(rows) + 10, " ".join(own)))
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], DOCS).repartition(3)
    got = near_dedup.near_duplicates(docs, size, 80).collect()
    want = brute_components(rows, size, 80)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]) and r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    kept = near_dedup.drop_near_duplicates(docs, size, 80)
    assert kept.columns == docs.columns and kept.count() == len(set(want.values())) + 1


def test_rare_shingles_lose_no_pair(spark):
    """The last comparison alone, without bands, finds every near pair."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"y{rng.randrange(5)}" for w in base)) for i in range(25)]
    sets = [(i, near_dedup.shingle_set(t, near_dedup.WordIds(), 2)) for i, t in rows]
    classes = spark.createDataFrame([(i, len(s)) for i, s in sets], "id long, n_shingles long")
    texts = spark.createDataFrame(rows, "id long, text string")
    open_ = spark.createDataFrame([(i, i) for i, _ in sets], "id long, component long")
    got = {(r.a, r.b) for r in near_dedup.sharing_rare(open_, classes, texts, 2, 80).collect()}
    want = {(i, j) for i, a in sets for j, b in sets if i < j and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
    assert want and want <= got


@pytest.mark.parametrize("per_task", [40, 1_000_000])
def test_components_in_one_share_and_in_many(spark, per_task):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1090)] + [(5000, i) for i in range(4000, 4050)] + [(7, 7)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = near_dedup.connected(spark.createDataFrame(edges, "a long, b long").repartition(8), per_task=per_task).collect()
    assert len(got) == len(root) and {r.id: r.component for r in got} == {x: find(x) for x in root}


def test_near_duplicates_of_no_rows(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (8000, 1000, 1000))
    x, y = (near_dedup.registers_of(np.concatenate([both, s])) for s in (a, b))
    value, error = near_dedup.estimate(x, y, 9000, 9000)
    assert abs(value - 0.8) < 4 * error
    value, error = near_dedup.estimate(near_dedup.registers_of(a), near_dedup.registers_of(b), 1000, 1000)
    assert value < 4 * error


MESSAGES = [
    (1, 0, "user", "Where does the river rise?\nAnd where does it end?", 1),
    (1, 1, "assistant", "It rises in the hills.", 1),
    (1, 2, "user", "> where does  the river rise?\nThanks, and its length?", 1),
    (1, 3, "assistant", ">> Where does the river rise?\n> Thanks, and its length?\nTwo hundred miles.", 1),
    (1, 4, None, "> not said by anyone here\nHello", 1),
    (2, 0, "user", None, 1), (2, 0, "user", None, 1), (None, 0, "user", "It rises in the hills.", 1), (3, None, "user", "> It rises in the hills.", 1), (2, 1, "assistant", "> It rises in the hills.", 1),
]


def brute_places(links):
    """(conv, turn): parent, root, depth, place, by walking down from the roots."""
    below, out = {}, {}
    for conv, turn, parent in links:
        below.setdefault((conv, parent), []).append(turn)
    for conv, root in {(c, p) for c, _, p in links} - {(c, t) for c, t, _ in links}:
        stack, place = [(root, None, 0)], 0
        while stack:
            turn, parent, depth = stack.pop()
            out[conv, turn] = (parent, root, depth, place)
            place += 1
            stack += [(t, turn, depth + 1) for t in sorted(below.get((conv, turn), []), reverse=True)]
    return out


def test_chat(spark):
    frame = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string, body int")
    rows = chat.chat_messages(frame).collect()
    assert len(rows) == len(MESSAGES)
    got = {r.turn: r for r in rows if r.conv_id == 1}
    assert [got[t].parent_turn for t in range(5)] == [None, None, 0, 2, None]
    assert [(got[t].depth, got[t].reply_place) for t in range(5)] == [(0, 0), (0, 0), (1, 1), (2, 2), (0, 0)] and got[3].root_turn == 0
    assert got[2].body == "Thanks, and its length?" and got[3].chat == "<|assistant|>\nTwo hundred miles." and got[3].levels == 2 and got[3].n_quoted == 2
    assert [r.turn for r in chat.in_reply_order(frame).collect() if r.conv_id == 1] == [0, 2, 3, 1, 4]
    assert {r.parent_turn for r in rows if r.conv_id != 1} == {None}
    assert chat.chat_messages(frame.limit(0)).count() == 0


def test_reply_order(spark):
    rng = random.Random(8)
    big = 2**62
    links = [(c, t, rng.choice([None, None, *range(t)])) for c in range(5) for t in range(1, 60)] + [(7, big + t, big + t - 1) for t in range(300)] + [(8, t, -5) for t in range(-4, 200)]
    links = [x for x in links if x[2] is not None]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.reply_place) for r in chat.reply_order(spark.createDataFrame(links, "conv_id long, turn long, parent_turn long")).collect()}
    assert got == brute_places(links)


def test_short_quotes_belong_to_the_message_before(spark):
    rows = [(1, 10000000001, "user", "Why not?"), (1, 10000000002, "user", "Why not?"), (1, 10000000003, "user", "> Why not?\nSo."), (1, 10000000005, "user", "> So.\n> why NOT?"), (1, 10000000006, "user", "> !?\n> ...")]
    got = chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 10000000003, 10000000002)]


def test_chat_replies_of_derived_quotes(spark):
    long = [(7, t, "user", f"message number {t}\nits second line {t}") for t in range(40)]
    frame = spark.createDataFrame([*long, (8, 0, "user", "the first message"), (8, 0, "user", "zzz another one"), (8, 1, None, None), (8, 3, "user", "alone here"), (None, 1, "user", "x"), (9, None, "user", "x")], "conv_id long, turn long, role string, text string")
    derived = chat.quoting(frame)
    assert derived.count() == frame.count()
    texts = {(r.conv_id, r.turn): r.text for r in derived.collect()}
    assert texts[7, 2] == ">> message number 0\n>> its second line 0\n> message number 1\n> its second line 1\nmessage number 2\nits second line 2" and texts[7, 3].startswith(">> its second line 2\nmessage") and texts[7, 4] == long[4][3]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.reply_place) for r in chat.reply_order(chat.link_quotes(derived)).collect()}
    links = [(7, t, t - 1) for t in range(40) if t % 4] + [(8, 1, 0)]
    assert got == brute_places(links)
    shown = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.reply_place) for r in chat.chat_messages(derived).collect() if (r.conv_id, r.turn) in got}
    assert shown == got


def test_quotes_of_very_many_lines(spark):
    """Lines of nothing but marks, and messages of very many lines, cost in proportion."""
    lines = [f"line number {i}" for i in range(30_000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "\n".join(f"> {x}" if i % 2 else x for i, x in enumerate(lines))), (1, 2, "user", ">" * 100_000 + " x\n" + "> " * 50_000)]
    got = {r.turn: r for r in chat.chat_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].parent_turn, got[1].n_quoted, got[2].levels, got[2].parent_turn) == (0, 15_000, 100_000, None)


def test_url_list(spark):
    day = lambda n: datetime.date(2024, 1, n)
    entries = spark.createDataFrame([("domain", "b.com", "block", day(5)), ("domain", "b.com", "remove", day(10)), ("host", "a.b.com", "allow", day(7)), ("url", "http://x.org/1", "block", day(1)), ("domain", "b.com", "block", day(5)), ("host", None, "block", day(1))], "kind string, value string, action string, since date")
    urls = [("http://a.b.com/x", 4), ("http://a.b.com/x", 6), ("http://u@C.b.com.:80/x", 6), ("http://a.b.com/x", 8), ("http://c.b.com/", 10), ("http://x.org/1", 2), ("http://x.org/2", 2), (None, 2), ("nothing", 2), ("http://nb.com/", 6)]
    captures = spark.createDataFrame([(u, day(n), "v") for u, n in [*urls, urls[0]]] + [("http://x.org/1", None, "v")], "url string, fetched date, value string")
    got = sorted((r.url or "", r.fetched.day if r.fetched else 0, r.verdict) for r in url_filter.judge(captures, entries).collect())
    want = sorted([("http://a.b.com/x", 4, "none")] * 2 + [("http://a.b.com/x", 6, "block"), ("http://u@C.b.com.:80/x", 6, "block"), ("http://a.b.com/x", 8, "allow"), ("http://c.b.com/", 10, "none"), ("http://x.org/1", 2, "block"), ("http://x.org/2", 2, "none"), ("", 2, "none"), ("nothing", 2, "none"), ("http://nb.com/", 6, "none"), ("http://x.org/1", 0, "none")])
    assert got == want
    assert {r.verdict for r in url_filter.judge(captures, entries.limit(0)).collect()} == {"none"} and url_filter.judge(captures.limit(0), entries).count() == 0


def test_hot_keys_and_broadcasts_change_nothing(spark, monkeypatch):
    """Every key that comes twice is hot, and no ids are few enough to be broadcast."""
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    test_near_duplicates(spark, 2)
    test_chat(spark)
    test_chat_replies_of_derived_quotes(spark)
    test_url_list(spark)


def test_url_columns_that_clash(spark):
    entries = spark.createDataFrame([("url", "http://x.org/1", "block", datetime.date(2024, 1, 1))], "kind string, value string, action string, since date")
    captures = spark.createDataFrame([("http://x.org/1", datetime.date(2024, 1, 2), 1, 2, 3, 4)], "url string, fetched date, of_host int, of_url int, _e int, n int")
    row = url_filter.judge(captures, entries).first()
    assert (row.verdict, row.of_host, row.of_url, row["_e"], row.n) == ("block", 1, 2, 3, 4)
    assert url_filter.keep_allowed(captures, entries).columns == captures.columns


def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = sharding.hilbert_index(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    rows = [(i, f"text {i % 7}", "en" if i % 3 else None, "src0" if i % 2 else f"s{i}", i, "x") for i in range(205)] + [(None, None, None, None, None, None), (5, "text 5", "en", "src0", 5, "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sharding.shard_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        text = "" if r.doc_id is None else f"text {r.doc_id % 7}"
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text.encode()))
    assert sorted(by) == list(range(40)) and {len(x) for x in by.values()} == {5, 6} and len(got) == len(rows)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    few = sharding.shard_documents(docs.limit(3)).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)] and sharding.shard_documents(docs.limit(0)).count() == 0


def test_shards_follow_the_curve_and_prune(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(10**6), "x" * rng.randrange(4000), rng.choice("abcdef"), f"s{rng.randrange(500)}", 1, "x") for _ in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    want = sorted(got, key=lambda r: (r.curve, r.doc_id, r.size, r.text_crc32))
    assert [(r.shard, r.slot) for r in want] == [(i // 75, i % 75) for i in range(3000)]
    boxes = {}
    for r in got:
        boxes.setdefault(r.shard, []).append((r.size, r.doc_id, r.lang))
    read = sum(min(x[0] for x in b) <= 500 and min(x[1] for x in b) <= 200_000 and min(x[2] for x in b) <= "a" for b in boxes.values())
    assert read <= 12  # of 40: most shards need not be opened for small documents of low ids in one language


@pytest.mark.parametrize("names", [20, 12_000])
def test_names_are_quantised_alike_at_every_number(spark, names):
    values = spark.range(names).selectExpr("concat('n', lpad(id, 6, '0')) AS name")
    bounds = sharding.string_bounds(values, 31)
    cells = [sum(b <= f"n{i:06d}" for b in bounds) for i in range(names)]
    ranks = sorted({i * 31 // names for i in range(names)})
    assert cells == [1 + ranks.index(i * 31 // names) for i in range(names)]


def test_written_shards_hold_each_row_once(spark, tmp_path):
    rows = [(5, "a", "en", "s", 1, "x"), (5, "b", "en", "s", 1, "y"), (5, "a", "en", "s", 1, "x"), (None, None, None, None, None, None), (7, "long text", "de", "t", 9, "z")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("mine")).withColumn("curve", F.lit(1))
    manifest = {r.shard: r for r in sharding.write_shards(docs, str(tmp_path / "a"), 3).collect()}
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(map(repr, back.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert {r[0]: r[1] for r in back.groupBy("_shard").count().collect()} == {k: r.rows for k, r in manifest.items()} == {0: 2, 1: 2, 2: 1}
    assert sharding.write_shards(docs.limit(0), str(tmp_path / "b"), 3).count() == 0


def test_one_of_several_texts_under_one_id_is_kept(spark):
    rows = [(1, "b c d e f g", "en", "s", 1, "x"), (1, "a c d", "en", "s", 1, "x"), (1, None, "en", "s", 1, "x"), (2, "z", "en", "s", 1, "x"), (2, "z", "en", "s", 1, "w"), (None, "z", "en", "s", 1, "x")]
    got = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([rows[1], rows[4], rows[5]], key=repr) or sorted((r.doc_id or 0, r.text) for r in got) == [(0, "z"), (1, "a c d"), (2, "z")]


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.train(docs.where(~language_id.held_out()))
    pieces, kept = language_id.pieces_of(model.vocabulary), set()
    for r in rows.values():
        words = regex.findall(language_id.WORDS, (r.text or "").lower())
        if words and model.languages:
            total = sum(n * language_id.forward(w, pieces, model.chances) for w, n in Counter(words).items())
            if 1 / np.exp(np.clip(total - total.max(), -700, 0)).sum() >= 0.5:
                kept.add(r.doc_id)
    now = corpus_pipeline.language(spark, docs, SF)
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == kept
    label = brute_components([(d, rows[d].text) for d in kept], 5, 80)
    kept = set(label.values())
    now = corpus_pipeline.near_duplicates(spark, now, SF)
    assert now.columns == docs.columns and sorted(r.doc_id for r in now.collect()) == sorted(kept)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {d for d in kept if not brute_contamination(rows[d].text, items)[-1]}
    now = corpus_pipeline.benchmark(spark, now, SF)
    assert now.columns == docs.columns and sorted(r.doc_id for r in now.collect()) == sorted(kept)
    now = corpus_pipeline.secret_scan(spark, now, SF)
    clean = {r.doc_id: r for r in now.collect()}
    assert now.columns == docs.columns and {d: r.text for d, r in clean.items()} == {d: brute_redacted(rows[d].text) for d in kept}
    assert all((r.lang, r.source, r.n_chars) == (rows[d].lang, rows[d].source, rows[d].n_chars) for d, r in clean.items())
    packed = corpus_pipeline.pack(spark, now, SF)
    assert {r.doc_id for r in packed.collect()} == kept and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows; and nulls, empty texts, repeated rows and another column."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    odd = [(None, None, None, None, None, None), (1, "", "en", "s", 0, "x"), *[(2, "some words of english", "en", "s", 5, "x")] * 2, (None, "some words of english", "en", "s", 5, "x")]
    for name, rows in (("none", []), ("odd", odd)):
        benchmark.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert [r.doc_id for r in sorted(got, key=lambda r: r.doc_id or 0)] == ([None, 2] if rows else [])


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.language(spark, docs, SF)
    assert one.columns == docs.columns and one.count() >= 0.95 * docs.where("text rlike '[A-Za-z]'").count()
    packed = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert kept <= {r.doc_id for r in one.collect()} and packed.where("length > 1024").count() == 0
