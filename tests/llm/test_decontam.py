import re
from collections import defaultdict

from corpusloom.llm import decontam, queries


def test_canonical_slots():
    got = decontam.Tokens(["Then Alice bought 12 kg of rice for 3.5km.\nBob left", None, "", "kg. He 5"], decontam.word_codes(["then", "he"]))
    assert got.slot.astype(int).tolist() == [0, 1, 0, 1, 1, 0, 0, 0, 1, 1, 1, 0, 0, 0, 1]
    assert got.code[1] == got.code[10] == decontam.NAME and got.code[3] == decontam.NUM and got.code[4] == decontam.UNIT
    assert got.value(1) == "alice" and got.value(11) == "left" and got.text.tolist() == [0] * 12 + [3] * 3 and got.first.tolist() == [0, 12, 12, 12, 15]


def test_batches_equal_single_texts(texts):
    """Tokens and windows of a batch of texts are those of each text alone."""
    some = [texts[d] for d in sorted(texts)[:40]] + [None, "", "x"]
    known = decontam.word_codes("the der die el la le".split())
    whole = decontam.Tokens(some, known)
    for k, t in enumerate(some):
        one = decontam.Tokens([t], known)
        part = slice(whole.first[k], whole.first[k + 1])
        assert (one.code == whole.code[part]).all() and (one.own == whole.own[part]).all() and (one.slot == whole.slot[part]).all()
    template, own, kind = whole.windows(8)
    assert sum((decontam.Tokens([t], known).windows(8)[2] > 0).sum() for t in some) == (kind > 0).sum()


ITEM = "A train with Alice on board leaves the old station at 9 and runs 120 km before Alice meets the other train there"


def test_reparameterised(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, ""), (1, ITEM)], "item_id long, text string")
    changed = ITEM.replace("Alice", "Robert").replace("120", "75").replace("9", "11")
    mixed = ITEM.replace("Alice", "Robert", 1).replace("120 km", "75 km")
    docs = [(10, f"Some words. {ITEM} and more"), (11, f"well now {changed} yes"), (12, mixed), (13, "nothing of the kind " * 9), (14, None), (15, ""), (10, f"Some words. {ITEM} and more"), (None, ITEM)]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (None, 1)}
    assert got[(10, 1)].kind == "verbatim" and got[(11, 1)].kind == "reparameterised" and got[(11, 1)].n_changed >= 4
    left = decontam.decontaminated(spark.createDataFrame(docs, "doc_id long, text string, value int".replace(", value int", "")), bench)
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [12, 13, 14, 15]


def test_occurrences(spark):
    """Several places of one document that meet an item: a variant beside a copy or another variant, two items of a template."""
    one, two = ITEM.replace("Alice", "Robert").replace("120", "75").replace("9", "11"), ITEM.replace("Alice", "Mona").replace("120", "64").replace("9", "5")
    long = ITEM.replace("Alice", "Robert Brown").replace("120", "75")  # a longer name moves the diagonal
    bench = spark.createDataFrame([(1, ITEM), (2, one)], "item_id long, text string")
    docs = {
        20: f"{ITEM}. Then {one}", 21: f"{ITEM}. Then {ITEM}. Then {two}", 22: f"{two}. And so on, as they say, {one}", 23: f"{two}. Then {long}",
        24: ITEM.replace("Alice", "Robert", 1).replace("120 km", "75 km") + ". Then " + ITEM.replace("Alice", "Mona", 1).replace("120 km", "64 km"),
    }
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench).collect()}
    assert set(got) == {(d, i) for d in (20, 21, 22, 23) for i in (1, 2)}
    assert got[(20, 1)].kind == got[(20, 2)].kind == got[(21, 1)].kind == got[(22, 2)].kind == "verbatim" and got[(22, 1)].kind == "reparameterised"
    assert all(r.consistency == 1 for k, r in got.items() if k[0] != 23)


def test_few_literals_and_excerpts(spark):
    """Copies of items that hold hardly any literal token, of very short ones, and excerpts below half of an item."""
    words = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "ho") for b in ("lar", "men", "nit", "pol", "ras", "sud", "tek", "vun", "wim", "zor")]
    long = " ".join(words)  # 60 tokens
    dense = "Total due 12 34 56 78 91 23 45 67 89 10 11 13 14 15 16 17 18 19 20 21"
    items = [(1, "What is 12 + 30 * 4 - 7?"), (2, "why is that"), (3, long), (4, dense), (5, "zyzzyva"), (6, "!!!")]
    docs = [
        (30, "Now: What is 12 + 30 * 4 - 7? Well"), (31, "Now: What is 12 + 30 * 4 - 8? Well"), (32, "ask him why is that so"), (33, "why that is"),
        (34, "one two " + " ".join(words[20:50]) + " end"), (35, " ".join(words[20:32]) + " end"), (36, f"see {dense} there"),
        (37, "see " + dense.replace("1", "9") + " there"), (38, "A Zyzzyva! !!!"),
    ]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(30, 1), (32, 2), (34, 3), (36, 4), (38, 5)}
    assert all(r.kind == "verbatim" and r.consistency == 1 for r in found)


def test_benchmark_passages(spark, sf, texts):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    words = lambda t: re.findall(r"\w+", t.lower())
    index = defaultdict(set)
    total = {}
    for i, t in bench.items():
        own = {tuple(w) for w in zip(*[words(t)[k:] for k in range(5)])}
        total[i] = len(own)
        for w in own:
            index[w].add(i)
    want = set()
    for d, t in texts.items():
        seen = defaultdict(set)
        for w in zip(*[words(t)[k:] for k in range(5)]):
            for i in index.get(w, ()):
                seen[i].add(w)
        want |= {(d, i) for i, s in seen.items() if len(s) > 0.7 * total[i]}
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, sf).collect()}
    assert got == want


NAMES = "Natalia Weng Tina Robert Mona Igor Paula Chen Aisha Bruno Carla Dmitri Elena Farid Greta Hugo".split()
THINGS = "clips cakes apples pencils marbles stamps coins shells bottles ribbons candles tickets".split()
VERBS = "sold baked bought found gave lent painted sorted packed counted traded borrowed".split()
PLACES = "market school garden station library bakery harbour stadium museum theatre".split()


def problem(k, names, numbers):
    """The k-th word problem: sentences begin with names."""
    a, b, c = THINGS[k % 12], THINGS[(k * 5 + 1) % 12], THINGS[(k * 7 + 3) % 12]
    v, w = VERBS[(k * 3) % 12], VERBS[(k * 11 + 5) % 12]
    place, other = PLACES[k % 10], PLACES[(k // 10 + 3) % 10]
    return f"{names[0]} {v} {numbers[0]} {a} near the {place} this spring. {names[1]} {w} {numbers[1]} {b} for everyone at the {other}. {names[2]} paid {numbers[2]} dollars and {names[0]} kept {numbers[3]} {c} in a box. How many {a} are left?"


def test_names_that_begin_sentences(spark):
    item = "Natalia sold 48 clips to her friends. Weng baked 12 cakes for them. Tina paid 30 dollars for all of it."
    doc = "Robert sold 15 clips to her friends. Mona baked 7 cakes for them. Igor paid 99 dollars for all of it."
    got = decontam.contaminated(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.kind, r.n_windows, r.coverage) for r in got] == [(1, 5, "reparameterised", 14, 1.0)]


def test_generated_problems(spark):
    """Word problems with other names and numbers are found, other problems and prose are not."""
    items = [(k, problem(k, [NAMES[k % 16], NAMES[(k + 5) % 16], NAMES[(k + 9) % 16]], [k + 3, 2 * k + 5, 40 + k, k % 7 + 2])) for k in range(60)]
    docs = [(100 + k, "We read on.\n" + problem(k, [NAMES[(k + 3) % 16], NAMES[(k + 7) % 16], NAMES[(k + 12) % 16]], [90 - k, 17 + k, 8 + k, 33]) + "\nThat was it.") for k in range(60)]
    clean = [(1000 + k, f"The {PLACES[k % 10]} was open this spring. How many people came is not known. {NAMES[k % 16]} paid for the tickets and {VERBS[k % 12]} the rest at the {PLACES[(k + 4) % 10]} for everyone.") for k in range(60)]
    found = decontam.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert sum((100 + k, k) in pairs for k in range(60)) >= 57
    assert not any(d >= 1000 for d, _ in pairs)
    full = [f"{n} {m}" for n, m in zip(NAMES, NAMES[7:] + NAMES[:7])]
    numbers = "thirteen;sixty;twenty-one;ninety".split(";")
    docs = [(100 + k, problem(k, [full[(k + 3) % 16], full[(k + 7) % 16], full[(k + 12) % 16]], [numbers[(k + j) % 4] for j in range(4)])) for k in range(60)]
    again = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((100 + k, k) in again for k in range(60)) >= 57 and not any(d >= 1000 for d, _ in again)


def test_longer_names_and_number_words(spark):
    """Names of two words in place of one, number words, numbers tied by a hyphen."""
    items = {
        1: "Natalia sold 48 clips to her friends. Weng baked 12 cakes for them. Tina paid 30 dollars for all of it.",
        2: "the old baker put thirteen loaves on the shelf and took nineteen of them back to the shop later",
        3: "a 5-year-old horse ran the 3-mile race in less time than its owner had hoped for that day",
        4: "der alte Mann hat zwanzig Äpfel und dreizehn Birnen auf den Markt gebracht und wieder mitgenommen",
        5: "le marchand a vendu quinze pommes et trente poires au voisin avant de rentrer chez lui hier",
    }
    docs = {
        1: "Mary Jane sold 15 clips to her friends. Jo Ann baked 7 cakes for them. Ana Maria paid 99 dollars for all of it.",
        2: "the old baker put sixty two loaves on the shelf and took seventeen of them back to the shop later",
        3: "a 7-year-old horse ran the 12-mile race in less time than its owner had hoped for that day",
        4: "der alte Mann hat 31 Äpfel und siebenundvierzig Birnen auf den Markt gebracht und wieder mitgenommen",
        5: "le marchand a vendu vingt-deux pommes et soixante-dix poires au voisin avant de rentrer chez lui hier",
        6: "the old baker put his loaves on the shelf and then he took some time to look at the horse and the race",
    }
    made = lambda rows, name: spark.createDataFrame([(k, t) for k, t in rows.items()], f"{name} long, text string")
    got = decontam.contaminated(made(docs, "doc_id"), made(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(k, k, "reparameterised") for k in range(1, 6)}


def test_joined_tokens():
    none = decontam.word_codes([])
    tokens = decontam.Tokens(["he met Mary  Jane, Jo\nAnn and two hundred men of The New Old Big House at 3 million or 5 6"], none)
    assert [tokens.value(k) for k in range(len(tokens.code))] == "he met maryjane jo ann and twohundred men of the new old big house at 3million or 5 6".split()
    assert [tokens.value(k) for k in range(4)] == ["he", "met", "maryjane", "jo"] and tokens.code[2] == decontam.NAME and tokens.code[6] == decontam.NUM


def test_rows_are_told_apart_by_their_texts(spark):
    """Null ids and shared ids: neither pools texts, keeps a leak, nor loses a clean document."""
    words = ITEM.split()
    rows = [
        (None, "one " + " ".join(words[:12]), 1), (None, "two " + " ".join(words[8:16]), 2), (None, f"leak {ITEM}", 3), (7, f"leak again {ITEM}", 4), (7, "clean words under a shared id", 5),
        (8, "x " + " ".join(words[:10]), 6), (8, "y " + " ".join(words[9:18]), 7), (9, None, 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit int")
    bench = spark.createDataFrame([(1, ITEM), (1, "an item of the same id but with quite another text to it than that"), (None, ITEM)], "item_id long, text string")
    alone = {r.doc_id for r in decontam.contaminated(spark.createDataFrame([(n, t) for _, t, n in rows], "doc_id long, text string"), bench).collect()}
    left = decontam.decontaminated(docs, bench)
    assert left.columns == docs.columns and {r.hit for r in left.collect()} == {r[2] for r in rows} - alone and {3, 4} <= alone and not {5, 8} & alone
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect() if r.coverage == 1} == {(d, i) for d in (None, 7) for i in (1, None)}


def test_copies_in_other_case(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "Alice Bob Carol have 12 30 40 50 in Paris London Rome Berlin")], "item_id long, text string")
    docs = [(1, ITEM.lower()), (2, ITEM.upper()), (3, "so: Alice Bob Carol have 12 30 40 50 in Paris London Rome Berlin!"), (4, "Alice Bob Carol have 13 31 41 51 in Paris London Rome Berlin")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (3, 2)}


def test_clashing_names(spark):
    bench = spark.createDataFrame([(1, ITEM, 1, 2)], "item_id long, text string, hash int, coverage int")
    names = ["hit", "item", "at", "hash", "occ", "coverage", "kind", "part", "digest", "item_id", "best"]
    docs = spark.createDataFrame([(1, ITEM, *range(11)), (2, "other", *range(11))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert [tuple(r) for r in decontam.decontaminated(docs, bench).collect()] == [(2, "other", *range(11))]
    assert decontam.contaminated(docs, bench).count() == 1


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma delta alpha beta")], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(odd, bench).collect()} == {9, 10}
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0
    assert decontam.decontaminated(odd, bench).count() == odd.count() - 2
