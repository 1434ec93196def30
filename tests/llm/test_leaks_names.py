"""Benchmark copies whose names have another number of words, and copies that are verbatim but for what other readings see."""

import random

import pytest
from sigtrail.llm import decontaminate

CLIPS = "{0} sold 48 clips to friends in April. Then {0} sold half as many in May. How many clips did {0} sell in all?"
ITEMS = [
    (1, CLIPS.format("Natalia")),
    (2, "At noon Mary Ann gave Peter 30 plums and kept 12 of them for her sister"),
    (3, "In spring the old teacher Anna met her friend Peter near the river with Carla and Boris and Vera from Oslo"),
    (4, "Ann Lee Fox Ray Kim"),
]


@pytest.fixture(scope="module")
def find(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")

    def run(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r.doc_id: (list(r.item_ids), list(r.exact_ids)) for r in decontaminate.decontaminate(docs, bench).collect()}

    return run


def test_names_of_another_number_of_words(find):
    got = find([
        CLIPS.format("Mary Ann"), CLIPS.format("Mary-Ann").replace("48", "20"), "Before it.\n" + CLIPS.format("Jean  Marc Dubois"), ITEMS[1][1].replace("Mary Ann", "Olga"),
        ITEMS[1][1].replace("Mary Ann", "Olga Maria Lopez").replace("30", "7"), CLIPS.format("Mary Ann").replace("did Mary Ann", "did Peter Paul"),
    ])
    assert [got[k] for k in range(5)] == [([1], []), ([1], []), ([1], []), ([2], []), ([2], [])]
    assert got[5] == ([], [])  # one name can't be two


def test_verbatim_copies_are_exact(find):
    got = find([t for _, t in ITEMS] + ["Some words. " + ITEMS[2][1] + " and Ivan Petrov came.", ITEMS[0][1].replace("48", "49"), ITEMS[2][1].lower()])
    assert [got[k] for k in range(5)] == [([1], [1]), ([2], [2]), ([3], [3]), ([4], [4]), ([3], [3])]
    assert got[5] == ([1], []) and got[6] == ([3], [3])


def test_only_names_say_nothing(find):
    got = find(["Tom Bob Jim Max Joe", "Tom Bob Jim Max Joe met Sue Pam Liz Eve Amy", "Ann Lee Fox Ray Kim came"])
    assert got == {0: ([], []), 1: ([], []), 2: ([4], [4])}


def test_renamed_copies_against_plain_search(spark):
    """Items are lists of words and names; a document holds an item that it was made of, with each name replaced by one of any length."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 6)))
    name = lambda: " ".join(word().capitalize() for _ in range(draw.randint(1, 3)))
    items, docs, wanted = [], [], {}
    for i in range(40):
        cast = [name() for _ in range(draw.randint(1, 2))]
        parts = [word() if draw.random() < 0.7 or not k else None for k in range(20)]
        shape, last = [], None
        for p in parts:
            if p is None and last is None:  # names never touch, so that a run is one name
                p = word()
            shape.append(p if p is not None else draw.randrange(len(cast)))
            last = p
        said = lambda names, shape=shape: " ".join(x if isinstance(x, str) else names[x] for x in shape)
        items.append((i, said(cast)))
        for kind in range(3):
            names = cast if kind == 0 else [name() for _ in cast]
            text = said(names)
            if kind == 2:  # other words: no copy
                text = " ".join(w if w[0].isupper() else word() for w in text.split())
            wanted[len(docs)] = ([] if kind == 2 else [i], [i] if kind == 0 or text == items[-1][1] else [])
            docs.append((len(docs), f"{word()} {word()}, {text}, {word()}"))
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (list(r.item_ids), list(r.exact_ids)) for r in got} == wanted


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(None, ITEMS[0][1], 1, "x"), (None, ITEMS[0][1], 2, "y"), (7, None, 3, "z"), (7, "", 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, reading int, said string")
    bench = spark.createDataFrame([*ITEMS, (None, "no id here at all"), (9, None)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert sorted((r.doc_id or 0, list(r.exact_ids)) for r in got) == [(0, [1]), (0, [1]), (7, []), (7, [])]
