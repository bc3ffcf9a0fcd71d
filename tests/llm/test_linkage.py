from conftest import rows
from pyspark.sql import functions as F

from marlstone.llm import linkage

SCHEMA = "row_id bigint, parent_asin string, title string, features array<string>, store string"
BRANDS = ["Kahoga", "Samofi", "Gevavi", "Jafefi", "Retime", "Vetebi", "Gokofi", "Nidiso", "Busifi", "Lumaku"]
LINES = ["Kolipota", "Yawiliku", "Vohokafa", "Malezafa", "Garadani", "Bifiviha", "Liwikodi", "Helukapo", "Wirunewa", "Jayabilo"]
KINDS = ["travel flask", "coat comb", "folding saw", "face roller", "desk lamp"]
COLOURS, MATERIALS = ["navy", "teal", "olive", "coral"], ["steel", "cork", "oak"]


def catalogue():
    out, want, row = [], {}, 0
    for p in range(60):
        b, kind, colour, material = BRANDS[p % 10], KINDS[(p + p // 10) % 5], COLOURS[p % 4], MATERIALS[p % 3]
        line, model, grams = LINES[(p % 10 + p // 10) % 10], f"AB{10_000_000 + p * 137}", 500 + 50 * (p // 10)
        offers = [
            (f"{b} {line} {kind} {colour} AB {model[2:]}", [f"Size: {grams} g", f"made from {material}"]),
            (f"NEW! {kind} {b.upper()} {line[:3]}{line[4:]}, {grams / 28.349523125:.1f} oz", [f"Colour: {colour}", f"Made by {b}", "Hot deal"]),
            (f"{kind} {line.lower()}", [f"Brand: {b}", f"Comes in {colour}", f"Item no. {model.lower()}", f"{grams / 453.59237:.2f} lb in total"]),
            (f"{b} {line[:4]} {line[4:]} {kind}, {material}", [f"By {b}", f"From the {line} range", f"Measures {grams / 1000} kg"]),
        ]
        for k, (title, features) in enumerate(offers[: 2 + p % 3]):
            out.append((row, f"P{p:03d}{k}", title, features, f"store {k}"))
            want.setdefault(p, set()).add(f"P{p:03d}{k}")
            row += 1
        out.append((row, f"A{p:03d}", f"cover for {b} {line} {kind} {model}", ["Brand: Other", "Accessory only, main article not included"], "x"))
        row += 1
    return out, {frozenset(v) for v in want.values()}


def groups(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["product"], set()).add(r["parent_asin"])
    return {frozenset(v) for v in got.values()}


def test_products(spark):
    data, want = catalogue()
    again = [(900, data[0][1], None, None, None), (901, data[0][1], data[0][2], data[0][3], "again"), (902, None, "x", ["y"], None), (903, "E1", None, None, None), (904, "E2", "", [], ""), (905, "E3", "zz " * 20_000, [None, "q" * 50_000], "s"), (None, "E4", "word", None, None)]
    df = spark.createDataFrame(data + again, SCHEMA).withColumn("key", F.lit("clash")).repartition(3)
    found = linkage.products(df).cache()
    assert groups(found) == want
    pairs = {tuple(r) for r in linkage.product_pairs(found).collect()}
    assert pairs == {(a, b) for g in want for a in g for b in g if a < b}


def linked_groups(spark, monkeypatch, readings, edges):
    """Groups of products() for given readings (key, model) and links (a, b)."""
    fields = "key string, model string, size struct<dim:string,value:double,error:double>, line string, brand string, colour string, material string, kind array<string>, accessory boolean"
    listings = spark.createDataFrame([(k, m, None, None, k, None, None, None, False) for k, m in readings], fields)
    linked = spark.createDataFrame([(a, b, 5.0) for a, b in edges], "a string, b string, odds double")
    monkeypatch.setattr(linkage, "read_listings", lambda *_: listings)
    monkeypatch.setattr(linkage, "links", lambda *_: linked)
    return groups(linkage.products(None))


def test_links_are_followed_to_their_end(spark, monkeypatch):
    readings = [("K0", "ab12345678"), *[(f"K{i}", None) for i in range(1, 6)], ("L1", None), ("L2", None)]
    edges = [*[(f"K{i}", f"K{i + 1}") for i in range(5)], ("L1", "L2")]
    assert linked_groups(spark, monkeypatch, readings, edges) == {frozenset(f"K{i}" for i in range(6)), frozenset(("L1", "L2"))}


def test_one_number_of_contradicting_sizes_is_two_products(spark):
    data, want = catalogue()
    for k, grams in enumerate((700, 700, 9000, 9000)):
        title = f"Kahoga Zulimapo desk lamp {COLOURS[k % 2]} ZZ 55555555"
        data.append((800 + k, f"Z{k}", title, ["Brand: Kahoga", f"Size: {grams} g", "made from oak"], "x"))
    found = groups(linkage.products(spark.createDataFrame(data, SCHEMA)))
    assert found == want | {frozenset(("Z0", "Z1")), frozenset(("Z2", "Z3"))}


def test_empty(spark):
    assert rows(linkage.products(spark.createDataFrame([], SCHEMA))) == []


def test_reading(spark):
    texts = ["2.2 lb", "1000 gram", "pack of 9", "9-pack", "9 pcs", "16.9 fl oz", '13"', "0.155 kw", "big", "35.3 oz / 1 kg"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(linkage.size_of(F.col("t"))).collect()]
    assert [(g.dim, round(g.value)) if g else None for g in got] == [("g", 998), ("g", 1000), ("n", 9), ("n", 9), ("n", 9), ("ml", 500), ("mm", 330), ("w", 155), None, ("g", 1001)]
    models = ["flask zk/06715110b, navy", "or 45569569", "item ab12", "x1234567"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in models], "t string").select(linkage.model_of(F.col("t"))).collect()] == ["zk06715110b", "or45569569", None, None]


def test_long_features_are_read(spark):
    tail = ", as printed on the back of the box and on the first page of the manual that comes with it"
    data = [(1, "A", "lamp", [f"Item no. AB 12345678{tail}", f"Size: 500 g{tail}"], None), (2, "B", "lamp", [f"Accessory only, main article not included{tail}"], None)]
    got = {r["key"]: r for r in linkage.read_listings(spark.createDataFrame(data, SCHEMA), "parent_asin", "row_id", "title", "features").collect()}
    assert (got["A"]["model"], got["A"]["size"]["value"], got["A"]["accessory"], got["B"]["accessory"]) == ("ab12345678", 500.0, False, True)


def test_fit_tells_matches_from_others():
    counts = {"0222222": 500, "0222022": 200, "0112111": 900, "0011111": 800, "2222222": 300, "2230222": 50, "0122222": 400, "1122022": 300}
    odds = linkage.fit_linkage(counts)
    # products of one line that differ in size are no match, though they agree in all else
    assert min(odds[p] for p in ("0222222", "0222022", "2222222", "2230222")) > 2 and max(odds[p] for p in ("0112111", "0011111", "0122222", "1122022")) < -2
    assert linkage.fit_linkage({}) == {}


def test_weights_decide(spark, monkeypatch):
    data, want = catalogue()
    for k, grams in enumerate((700, 700, 9000, 9000)):
        data.append((800 + k, f"Z{k}", f"Kahoga Zulimapo desk lamp {COLOURS[k % 2]}", ["Brand: Kahoga", f"Size: {grams} g", "made from oak", f"Item no. ZZ {55555555 + k // 2}"], "x"))
    df = spark.createDataFrame(data, SCHEMA)
    assert groups(linkage.products(df)) == want | {frozenset(("Z0", "Z1")), frozenset(("Z2", "Z3"))}
    monkeypatch.setattr(linkage, "fit_linkage", lambda counts: dict.fromkeys(counts, 50.0))
    assert any({"Z0", "Z2"} <= g for g in groups(linkage.products(df)))
    monkeypatch.setattr(linkage, "fit_linkage", lambda counts: dict.fromkeys(counts, -50.0))
    assert groups(linkage.products(df)) == set()


def test_large_blocks_are_parted(spark):
    """A third of all classes in one block: what agrees in one more field is still paired, what agrees in none is not."""
    fields = "id string, model string, size struct<dim:string,value:double,error:double>, line string, brand string, colour string, material string, kind array<string>"
    row = lambda i: (f"r{i:03d}", None if i % 3 else f"ab{i:06d}", ("g", 500.0, 0.01), f"kol{i // 2:03d}ipo", "kahoga", None, None, None)
    classes = spark.createDataFrame([row(i) for i in range(200)], fields)
    free = lambda most: {tuple(r) for r in linkage.candidate_pairs(classes, most).collect() if int(r["a"][1:]) % 3 or int(r["b"][1:]) % 3}
    every, few = free(1000), free(20)
    same_line = {(f"r{i:03d}", f"r{i + 1:03d}") for i in range(0, 200, 2)}  # of two neighbours one has no number
    assert same_line <= few < every and len(few) < len(every) / 5


def test_large_blocks_lose_no_link(spark, monkeypatch):
    """One block of 162 classes: pairs that agree in no more than the block, or in nothing else exactly, are linked, each once."""
    fields = "id string, model string, size struct<dim:string,value:double,error:double>, line string, brand string, colour string, material string, kind array<string>"
    line = lambda i: "kol" + "abcdefghij"[i // 10] * 4 + "klmnopqrst"[i % 10] * 4 + "ipo"
    size = ("g", 500.0, 0.01)
    data = [(f"r{i:03d}", f"ab{i:06d}" if i % 2 else None, size, line(i), "kahoga", None, None, ["lamp"]) for i in range(100)]
    data += [(f"s{i:03d}", None, ("g", 501.0, 2.0), line(i)[:5] + line(i)[6:], "kahoga", None, None, None) for i in range(60)]  # a letter lost, size rounded
    data += [(f"t{k}", None, size, line(99), "kahoga", None, None, None) for k in range(2)]  # read the same
    classes = spark.createDataFrame(data, fields)
    monkeypatch.setattr(linkage, "fit_linkage", lambda counts: {p: 5.0 if p[:3] in ("022", "023") else -5.0 for p in counts})
    got = sorted((r["a"], r["b"]) for r in linkage.links(classes).collect())
    assert got == sorted([(f"r{i:03d}", f"s{i:03d}") for i in range(60)] + [("r099", "t0"), ("r099", "t1"), ("t0", "t1")])
    monkeypatch.setattr(linkage, "TILE_LOOKS", 7)
    assert sorted((r["a"], r["b"]) for r in linkage.links(classes).collect()) == got
