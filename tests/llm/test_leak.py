import random

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import leak

random.seed(7)
VOCAB = [f"w{i}" for i in range(3000)]
ITEM = [random.choice(VOCAB) for _ in range(60)]


def doc(middle, before=40, after=40):
    fill = lambda n: [f"f{random.randrange(5000)}" for _ in range(n)]
    return " ".join([*fill(before), *middle, *fill(after)])


def edited(ws, every):
    return [f"{w}x" if i % every == every - 1 else w for i, w in enumerate(ws)]


def found(texts, item=" ".join(ITEM)):
    return {d for d, _ in leak.ItemIndex([1], [item]).matches(texts)}


def test_whole_partial_edited_and_reordered_passages():
    texts = [doc(ITEM), doc(ITEM[20:46]), doc(edited(ITEM, 8)), doc(ITEM[30:] + ITEM[:30]), " ".join(ITEM).upper().replace(" ", ",\n "), doc(ITEM[:5]), doc(ITEM[10:30]), doc(random.sample(ITEM, 60)), ""]
    assert found(texts) == {0, 1, 2, 3, 4}


def test_short_items_and_edits_across_diagonals():
    for n in range(6, 21):
        item = ITEM[:n]
        part = max(6, -(-2 * n // 5))
        changed = [[*item[:k], "changed", *item[k + 1 :]] for k in range(n)] if n > 6 else []
        assert found([doc(x) for x in (item, item[:part], item[-part:], *changed)], " ".join(item)) == set(range(3 + len(changed))), n
        assert not found([doc(item[:5]), doc([*item[:5], "changed"])], " ".join(item)) if n > 6 else True
    rng = random.Random(5)
    for before in range(24):  # 18 of 43 words, two changed and one inserted
        a, b, c = sorted(rng.sample(range(3, 16, 4), 3))
        q = ITEM[12:30]
        q[a], q[b] = "one", "two"
        assert found([doc([*q[:c], "more", *q[c:]], before)], " ".join(ITEM[:43])) == {0}
    assert not found([doc([w for k in range(0, 35, 7) for w in (*ITEM[k : k + 3], "a", "b", "c", "d")])], " ".join(ITEM[:40]))  # a template, not light edits


def test_marks_and_scripts():
    item = "Café národní divadlo stál úplně prázdné a tiché v noci"
    assert found(["... cafe narodni divadlo stal uplne prazdne a tiche v noci ..."], item) == {0}
    assert found(["前雨は朝まで村の上に降り続いていた後"], "雨は朝まで村の上に降り続いていた") == {0}


def brute_tiles(a, b, least):
    """All longest free matches, by definition."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return out
        k, i, j = best[0], -best[1], -best[2]
        out.append((i, j, k))
        fa[i : i + k] = fb[j : j + k] = [False] * k


def test_tiling_marks_as_much_as_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(2, 26))], [rng.randrange(4) for _ in range(rng.randrange(2, 22))]
        got = leak.tiles(np.array(a), np.array(b), 3)
        assert all(a[i : i + k] == b[j : j + k] for i, j, k in got)
        want = sum(k for *_, k in brute_tiles(a, b, 3))
        assert want * 0.6 <= sum(k for *_, k in got) <= len(b)
        assert max((k for *_, k in got), default=0) >= max((k for *_, k in brute_tiles(a, b, 3)), default=0) / 2


def test_frames_blocks_and_edges(spark):
    text = " ".join(ITEM)
    docs = spark.createDataFrame([(1, doc(ITEM)), (1, doc(ITEM)), (2, None), (3, ""), (None, text), (4, "x " * 200_000 + text)], "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, text), (7, text), (8, None), (9, "one two three four five"), (10, ""), (11, " ".join(reversed(ITEM)))], "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    want = [(None, 7), (1, 7), (4, 7)]
    key = lambda p: (p[0] or 0, p[1])
    assert sorted(((r.doc_id, r.item_id) for r in leak.leaks(docs, items).collect()), key=key) == want
    assert len(leak.item_blocks(items, "item_id", "text", limit=100)) > 1
    assert leak.leaks(docs.limit(0), items).count() == 0 and leak.leaks(docs, items.limit(0)).count() == 0


def test_blocks_find_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, doc(ITEM[i : i + 40])) for i in range(6)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(ITEM[i:])) for i in range(5)], "item_id bigint, text string")
    whole = sorted(map(tuple, leak.leaks(docs, items).collect()))
    orig = leak.item_blocks
    monkeypatch.setattr(leak, "item_blocks", lambda *a: orig(*a, limit=300))
    assert sorted(map(tuple, leak.leaks(docs, items).collect())) == whole and len(whole) > 10


def test_random_quotes_in_any_order_of_blocks_are_all_found():
    """2,000 cases by definition: whole, partial, edited and reordered passages of items of 6 to 200 words."""
    rng, missed, wrong = random.Random(11), [], []
    for case in range(2000):
        n = rng.choice([*range(6, 30), 40, 60, 90, 140, 200])
        item = rng.sample(VOCAB, n)
        least = max(6, -(-2 * n // 5))
        kind = case % 4
        if kind == 0:  # one stretch
            m = rng.randrange(least, n + 1)
            at = rng.randrange(n - m + 1)
            quote = item[at : at + m]
        elif kind == 1:  # blocks of more than five words in another order
            size = rng.randrange(6, 14)
            blocks = [item[i : i + size] for i in range(0, n - size + 1, size)] or [item]
            while sum(map(len, blocks)) < least:
                blocks = [item]
            rng.shuffle(blocks)
            quote = [w for b in blocks for w in b]
        elif kind == 2:  # an edit every eight words or rarer, of the whole item
            quote = list(item)
            for i in range(rng.randrange(3, 8), n - 3, rng.randrange(8, 14)):
                quote[i : i + 1] = rng.choice([["changed"], [], [quote[i], "more"]])
        else:  # no case: five words, or a third of a long item
            quote = item[: 5 if n < 30 else n // 3]
        got = bool(found([doc(quote, rng.randrange(60), rng.randrange(60))], " ".join(item)))
        if got != (kind < 3):
            (missed if kind < 3 else wrong).append((kind, n, quote))
    assert not missed and not wrong, (len(missed), missed[:2], len(wrong), wrong[:2])
