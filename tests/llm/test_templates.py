import random

from partloom.llm import templates
from partloom.llm.queries import QUERIES
from tests.llm.frames import ODD, clash, documents, rows, words

SF = "/root/testdata/sf0.001"
ITEM = "item_id bigint, text string"
QUESTION = "A train leaves with 120 passengers and Maria counts 45 km of track while Maria pays 45 euros before the train stops at noon."


def found(spark, texts, items):
    return rows(templates.leaks(clash(documents(spark, texts)), spark.createDataFrame(items, ITEM)), "doc_id", "item_id")


def test_other_numbers_names_and_units_are_caught_if_they_are_consistent(spark):
    own = " ".join(words(random.Random(1), 40))
    fill = lambda q: f"{own} here. {q} Then {own}"
    other = QUESTION.replace("120", "77").replace("Maria", "Ahmed").replace("45", "9").replace("km", "miles").replace("euros", "dollars")
    wrong = other.replace("Ahmed counts", "Lena counts").replace("9 miles", "8 miles")
    texts = [(1, fill(QUESTION)), (2, fill(other)), (3, fill(wrong)), (4, own), (5, fill(QUESTION.lower())), (6, None)]
    got = templates.leaks(documents(spark, texts), spark.createDataFrame([(7, QUESTION), (8, None), (9, "too short")], ITEM))
    by = {r["doc_id"]: r["n_changed"] for r in got.collect()}
    assert by[1] == 0 and by[2] > 0 and 3 not in by and 4 not in by
    assert set(by) <= {1, 2, 5}


def test_query_finds_whole_items_and_nothing_else(spark):
    docs = [(r["doc_id"], r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, w in docs for i, b in items for at in range(len(w) - len(b) + 1) if w[at] == b[0] and w[at : at + len(b)] == b}
    got = set(rows(QUERIES["op2_template_leaks"](spark, SF), "doc_id", "item_id"))
    assert want and want <= got
    for d, i in got - want:  # parts of items: at least a run of 13 words in common
        w, b = dict(docs)[d], dict(items)[i]
        assert {tuple(w[k : k + 8]) for k in range(len(w) - 7)} & {tuple(b[k : k + 8]) for k in range(len(b) - 7)}


def test_part_of_an_item_and_short_items(spark):
    rng = random.Random(6)
    item, own = words(rng, 60), words(rng, 50)
    texts = [(1, " ".join(own[:9] + item[20:35] + own[9:])), (2, " ".join(own[:9] + item[20:30] + own[9:])), (3, "tail " + " ".join(item[:6]))]
    assert found(spark, texts, [(1, " ".join(item)), (2, " ".join(item[:6])), (3, " ".join(item[:4]))]) == [(1, 1), (3, 2)]


def test_items_of_few_words_are_found_as_whole_lines_or_texts(spark):
    texts = [(1, "some text\nSee also: this\nmore text"), (2, "see ALSO\nthis"), (3, "see also this one"), (4, "yes"), (5, "well yes")]
    items = [(1, "See also this"), (2, "Yes"), (3, "..."), (4, "")]
    assert found(spark, texts, items) == [(1, 1), (2, 1), (4, 2)]
    kept = templates.clean(documents(spark, texts), spark.createDataFrame(items, ITEM))
    assert rows(kept, "doc_id") == [(1,), (2,), (3,), (4,), (5,)]


def test_a_shared_prompt_leaks_no_item_and_makes_no_pairs(spark):
    rng = random.Random(8)
    prompt = "answer the following multiple choice question with one of the four letters given below"
    items = [(k, f"{prompt} {' '.join(words(rng, 12))}") for k in range(60)]
    own = [" ".join(words(rng, 30)) for _ in range(40)]
    texts = [(k, f"{own[k]}. {prompt} {own[k]}") for k in range(40)] + [(100 + k, f"{own[k]} {items[k][1]} {own[k]}") for k in range(5)]
    assert found(spark, texts, items) == [(100 + k, k) for k in range(5)]
    # The end of an item that differs from others by one word, and an item that is nothing but the prompt.
    ends = [(k, f"{prompt} end{w}") for k, w in enumerate(words(rng, 40))]
    same = [(100, ends[7][1]), (200, prompt)]
    texts = [(1, f"{own[0]} {ends[7][1]} {own[1]}"), (2, f"{own[0]} {prompt} {own[1]}"), (3, f"{own[0]} {prompt[:60]} {own[1]}")]
    got = found(spark, texts, ends + same)
    twins = {k for k, text in ends if text == ends[7][1]}
    assert {i for d, i in got if d == 1} == twins | {100, 200} and [i for d, i in got if d == 2] == [200] and not [i for d, i in got if d == 3]


def test_many_items_of_one_template_are_still_found_with_other_values(spark):
    fill = lambda n: f"A farmer has {n} sheep and buys {n + 3} goats, how many animals are there on the farm now?"
    items = [(k, fill(10 + k)) for k in range(30)]
    assert sorted(found(spark, [(1, fill(900))], items)) == [(1, k) for k in range(30)]


def test_odd_rows(spark):
    assert found(spark, ODD, [(1, QUESTION), (1, QUESTION), (None, QUESTION), (2, None), (3, "")]) == []
    assert found(spark, [(1, QUESTION), (1, QUESTION), (None, QUESTION)], [(1, QUESTION), (1, QUESTION)]) == [(1, 1)]
    assert found(spark, [], [(1, QUESTION)]) == [] and found(spark, [(1, QUESTION)], []) == []
    kept = templates.clean(clash(documents(spark, [(1, QUESTION), (2, "x"), (None, QUESTION)])), spark.createDataFrame([(1, QUESTION)], ITEM))
    assert rows(kept, "doc_id") == [(2,), (None,)]


def test_copies_in_another_case_or_after_other_words_are_found(spark):
    own = " ".join(words(random.Random(3), 40))
    short = "What river runs through Cairo"
    texts = [(1, f"{own} {QUESTION.lower()} {own}"), (2, f"{own} {QUESTION.upper()} {own}"), (3, f"{own}\n{short}\n{own}"), (4, f"{own}\n- {short}\n{own}"), (5, own)]
    assert found(spark, texts, [(1, QUESTION), (2, short)]) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    # A line break starts a sentence, with a bullet or without: the name in mid-sentence is a slot, the word before it is not.
    other = short.replace("Cairo", "Paris")
    assert found(spark, [(1, f"{own}\n{other}"), (2, f"{own}\n- {other}")], [(2, short)]) == [(1, 2), (2, 2)]


def test_what_is_written_alike_counts_where_other_values_contradict(spark):
    item = "So Maria and Maria counted the boxes in the store " + " ".join(words(random.Random(4), 20))
    text = item.replace("Maria and Maria", "Lena and Ahmed")
    assert found(spark, [(1, text)], [(1, item)]) == [(1, 1)]


def test_names_that_open_sentences_are_slots_if_they_are_consistent(spark):
    item = "Tom has 5 apples. Mary gives him 3 more. How many apples does Tom have now?"
    fill = lambda a, b, c, d, e: f"{a} has {b} apples. {c} gives him {d} more. How many apples does {e} have now?"
    texts = [(1, fill("Bob", 7, "Alice", 2, "Bob")), (2, fill("Bob", 7, "Alice", 2, "Carl")), (3, "Text here " + fill("Bob", 7, "Alice", 2, "Bob"))]
    got = templates.leaks(documents(spark, texts), spark.createDataFrame([(1, item)], ITEM))
    assert rows(got, "doc_id", "n_found", "n_windows", "n_changed") == [(1, 9, 9, 4), (3, 9, 9, 4)]
    # A word that opens a sentence is not taken for a name of an item of one window.
    assert found(spark, [(1, "Paris is the capital of France.")], [(1, "What is the capital of France")]) == []


def test_windows_of_few_literal_words_support_an_alignment(spark):
    fill = lambda v: f"Add up the numbers that are listed here: {' '.join(map(str, v))}"
    item, other, numbers = fill(range(10, 25)), fill(range(70, 85)), " ".join(map(str, range(70, 100)))
    got = templates.leaks(documents(spark, [(1, other), (2, numbers)]), spark.createDataFrame([(1, item), (2, " ".join(map(str, range(10, 25))))], ITEM))
    assert rows(got, "doc_id", "item_id", "n_found", "n_windows") == [(1, 1, 16, 16)]


def test_plain_words_are_read_like_any_other_token():
    rng = random.Random(9)
    parts = ["km", "The", "Maria", "USA", "A", "x", "%", "12", "é", "ß", ".", ",", ":", "!", "?", ";", "'", ")", "-", "…"]
    tokens = ["".join(rng.choices(parts, k=rng.randint(1, 4))).encode() for _ in range(20_000)] + [b"", b"\xff", b"kg."]
    assert [templates.facts(t) for t in tokens] == [templates._facts(t) for t in tokens]
