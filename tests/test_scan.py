"""Scanned images and labels against plain loops, and how their work grows."""

import random
import time

from pyspark.sql import functions as F

from larder.functions import scan, text as tx
from larder.plans import enrich, repair
from larder.sources import scans

HOST = "https://lh3.googleusercontent.com/p/"


def _photos(images):
    """One pass over the images of a place."""
    found = {}
    for image in images:
        url = image and image[0]
        if not url or "gstatic" in url:
            continue
        url = url.split("=")[0] if url.startswith(HOST) else url
        found.setdefault(url, None)
        if found[url] is None and image[1]:
            found[url] = image[1]
    return list(found.items())


def test_photos_equal_one_pass(spark):
    rng = random.Random(3)
    urls = [None, "", "https://maps.gstatic.com/1", *[f"{HOST}{i}{end}" for i in range(3) for end in ("", "=w80", "=s9")], "https://x.example/1"]
    rows = [(k, [None if rng.random() < 0.1 else (rng.choice(urls), rng.choice([None, "", "a", "b"])) for _ in range(rng.randint(0, 9))]) for k in range(200)]
    table = spark.createDataFrame([*rows, (200, None)], "k int, images array<struct<url:string,alt_text:string>>")
    got = {r.k: r.p for r in table.select("k", scan.photos(F.col("images")).alias("p")).collect()}
    assert got.pop(200) is None
    assert {k: [tuple(x) for x in p] for k, p in got.items()} == {k: _photos(images) for k, images in rows}


def test_photos_work_grows_with_the_images(spark):
    def seconds(images):
        every = F.transform(F.sequence(F.lit(1), F.lit(images)), lambda i: F.struct(F.concat(F.lit("https://x.example/"), i.cast("string")).alias("url"), F.lit("a").alias("alt_text")))
        rows = spark.range(1).select(every.alias("images")).select(scan.photos(F.col("images")).alias("p"))
        start = time.time()
        assert rows.select(F.size("p")).first()[0] == images
        return time.time() - start

    seconds(10)
    # All pairs of 20,000 different images take minutes.
    assert seconds(20_000) < 20


def test_label_keys_are_made_once(spark):
    labels = ["Quán cà phê", "Bánh mì & Phở", "COM tam", "Vietnamese restaurant", "Restaurant", "Coffee", " ", None, "Building"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string")
    made = rows.select("i", scan.label_slug(F.col("label")).alias("slug"))
    got = [r.slug for r in made.orderBy("i").collect()]
    assert got == ["coffee-shop", "snack", "rice", "vietnamese", "restaurant", "coffee-shop", None, None, None]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Normalizer") <= 4


def test_review_counts(spark):
    texts = ["4,5 (1.234)", "87 đánh giá", "12 Reviews", "4.8", "5.0", "9.1", "x 3 y 17", "[ 20 ]", "", None, "99999999999999999999"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = [r.n for r in rows.select("i", scan.review_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [1234, 87, 12, None, None, 91, 17, 20, None, None, None]


def test_phrases_work_grows_with_the_words(spark):
    texts = ["Một hai, ba", "a b c d e f", "", None, " x - y z"]
    made = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", enrich.phrases(F.col("t"), 2).alias("p"))
    got = [r.p for r in made.orderBy("i").collect()]
    assert got[0] == ["mot", "mot hai", "hai", "ba"] and got[1] == ["a", "a b", "b", "b c", "c", "c d", "d", "d e", "e", "e f", "f"]
    assert got[2:] == [[], None, ["x", "y", "y z", "z"]]
    # One run of 20,000 words; splitting it for every phrase takes minutes.
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i.cast("string")), " ").alias("t"))
    start = time.time()
    assert long.select(F.size(enrich.phrases(F.col("t"), 3))).first()[0] == 59_997
    assert time.time() - start < 20


def test_junk_keys_are_made_once(spark):
    names = ["Nhà Bè", "Karaoke Sao", "12 phường 3, Phường 4, quận 5, thành phố", "Phở Bò", " ", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, name string")
    found = rows.filter(repair.is_junk(F.col("name")))
    assert {r.i for r in found.collect()} <= {0, 1, 2} and 0 in {r.i for r in found.collect()}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_food_places_are_neither_area_cards_nor_other_places(spark):
    names = [None, "", " 　", "\n", "Quận 1", "Phở Bò", "Karaoke Mây", "chợ Bến Thành", "Go! Mall", "12 đường Quan", "Thủ Đức", "Green Farm", "Cityscape", "the  City", "Nhà  Bè", "mini ktv", "x^cho"]
    labels = [None, "", "Bệnh viện", "Quán  cà phê", "Pet shop", "petal", "gas station", "Chợ"]
    rows = spark.createDataFrame([(n, x) for n in names for x in labels], "name string, label string")
    c = F.col
    found = rows.select("name", "label", scan.is_food_place(c("name"), c("label")).alias("one"), (~scan.is_area_card(c("name")) & ~scan.is_not_food(c("name"), c("label"))).alias("two")).collect()
    assert all(r.one == r.two for r in found)
    assert {(r.name, r.label) for r in found if r.one} == {(n, x) for n in ("Phở Bò", "Cityscape", "x^cho") for x in (None, "", "Quán  cà phê", "petal")}


def test_runs_of_white_space_become_one_space(spark):
    texts = ["a b", " a  b ", "a\tb", "a  b", "　a\n\nb ", "a  b", "  ", "\t", "a b c  d"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.collapse("t").alias("out")).collect()
    assert [r.out for r in rows] == ["a b", "a b", "a b", "a b", "a b", "a b", "", "", "a b c d"]


def test_a_heading_is_folded_once(spark):
    places = spark.createDataFrame([("s", "u", "Phở Bò", 1, "x", [])], "scan_id string, url string, name string, review_count int, address string, images array<struct<url:string,alt_text:string>>")
    panel = places.select("scan_id", "url", F.upper("name").alias("name"), F.lit(7).alias("review_count"), F.lit("1").alias("phone"), F.lit("w").alias("website"), F.lit(2).alias("price_level"), "address", "images", F.lit("r").alias("reviews"))
    rows = scans.merge_details(places, panel)
    assert rows.first().review_count == 7
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Normalizer") == 2
