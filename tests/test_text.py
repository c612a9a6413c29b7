"""Text columns against plain Python definitions and worked examples."""

import random
import unicodedata

from pyspark.sql import functions as F

from larder import taxonomy as tax
from larder.functions import scan
from larder.functions import text as tx


def values(spark, texts, make, kind="string"):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, f"i int, t {kind}")
    return [r.v for r in frame.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_fold_and_keys(spark):
    texts = ["Cà Phê Sài Gòn", "Đậm đà", "PHỞ BÒ HUẾ", "Ớ́t", None]
    assert values(spark, texts, tx.fold) == ["ca phe sai gon", "đam đa", "pho bo hue", "ot", None]
    assert values(spark, ["  Đậm   Đà ", " "], tx.match_key) == ["dam da", None]


def test_nfkc_matches_unicodedata(spark):
    texts = ["Ｐｈở １２", "ﬁne ½ ™", "ế á", "plain", "ｶ №5", "x² …"]
    assert values(spark, texts, tx.nfkc) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_normal_forms_of_every_code_point(spark):
    """Every assigned code point alone and after a letter, and random sequences of marks, against the character database."""
    rng = random.Random(1)
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    marks = [c for c in points if unicodedata.combining(c)]
    texts = ["".join(points[k : k + 1]) for k in range(0, len(points))]
    texts += ["a" + m for m in marks] + ["".join(rng.choices(["e", "가", "ᄀ", "ᅡ", "ᆨ", "𑄱", "đ", "ß", *rng.choices(marks, k=3)], k=8)) for _ in range(5000)]
    rows = spark.createDataFrame([(t, unicodedata.normalize("NFKC", t), unicodedata.normalize("NFD", t)) for t in texts], "t string, c string, d string")
    wrong = rows.filter((tx.nfkc("t") != F.col("c")) | (tx.nfd("t") != F.col("d")))
    assert len(texts) > 140_000 and wrong.count() == 0


def test_clean(spark):
    assert values(spark, ["  Phở   Bò\t"], tx.clean) == ["Phở Bò"]


def test_terms_and_trigrams(spark):
    terms = values(spark, ["Tìm quán phở bò ngon gần đây phở a"], lambda c: tx.search_terms(c, tax.SEARCH_STOP_WORDS))
    assert terms == [["pho", "bo", "ngon", "ay"]]
    grams = values(spark, ["cat Cat!"], tx.trigrams)[0]
    assert sorted(grams) == ["  c", " ca", "at ", "cat"]
    assert values(spark, ["word"], lambda c: tx.similarity(c, F.lit("two words"))) == [4 / 11]


def test_ratings_and_counts(spark):
    assert values(spark, ["4.5", "4,5", "6.0", "-1.0", None, "4.8 (12)"], scan.rating) == [4.5, 4.5, None, None, None, 4.8]
    cases = {
        "1,283": 1283, "(1,283)": 1283, "42": 42, "": None, "not a number": None, "4.8 (1,283 reviews)": 1283,
        "1.283 đánh giá": 1283, "4,8 3.528 đánh giá": 3528, "4.8 3,528": 3528, "4.8 (3,528)": 3528, "4.8": None, "4,8": None,
        "5.0": None, "9,999,999": None, "7.5": 75,
    }
    assert dict(zip(cases, values(spark, list(cases), scan.review_count))) == cases


def test_any_white_space_is_blank(spark):
    assert values(spark, ["\t", "\u00a0 \u3000", "\n"], scan.is_area_card) == [True, True, True]


def test_name_filters(spark):
    assert values(spark, ["Thành phố Hồ Chí Minh", "Quận 1", "Bún Bò Huế 31", None], scan.is_area_card) == [True, True, False, True]
    cases = [
        ("Bệnh viện Đa khoa Nhà Bè", "Bệnh viện", True), ("Nha Khoa Thẩm Mỹ", None, True), ("Karaoke Dragon KTV", "Karaoke", True),
        ("Chợ Hải Sản 79", None, True), ("5ku Farm", None, True), ("Trung tâm hội nghị - tiệc cưới", None, True),
        ("Massage An Viên", "Massage", True), ("Coffee shop & Spa", "Coffee shop", False), ("Le Blanc. Coffee & Spaces", "Cà phê", False),
        ("PHỞ BÒ NGA - GẦN BỆNH VIỆN", "Nhà hàng", False), ("Bún Bò Huế chợ Đông Ba", "Nhà hàng", False), ("Cà phê Farmhouse", "Cà phê", False),
        ("đã đóng cửa", None, True), ("HỦ TIẾU MÌ KHÔNG TÊN", None, True), ("Go! Dĩ An", None, True), ("Nhà Bè", None, True),
        ("889 Phạm Thế Hiển, Phường 4, Quận 8, Thành phố Hồ Chí Minh", None, True),
    ]
    frame = spark.createDataFrame([(i, n, c) for i, (n, c, _) in enumerate(cases)], "i int, n string, c string")
    got = [r.v for r in frame.select("i", scan.is_not_food(F.col("n"), F.col("c")).alias("v")).orderBy("i").collect()]
    assert got == [expected for *_, expected in cases]


def test_dates(spark):
    now = F.lit("2024-06-10 12:00:00").cast("timestamp")
    cases = {
        "June 5, 2023": "2023-06-05 00:00:00", "2024-02-31": "2024-03-02 00:00:00", "hôm qua": "2024-06-09 12:00:00",
        "2 tuần trước": "2024-05-27 12:00:00", "a month ago": "2024-05-11 12:00:00", "một năm trước": "2023-06-11 12:00:00",
        "5 ngày trước": "2024-06-05 12:00:00", "1.5 hours ago": "2024-06-10 10:30:00", "năm năm trước": "2019-06-12 12:00:00",
        "0 days ago": None, "someday": None, "February 30, 2023": "2023-03-02 00:00:00",
    }
    got = values(spark, list(cases), lambda c: F.date_format(scan.review_date(c, now), "yyyy-MM-dd HH:mm:ss"))
    assert dict(zip(cases, got)) == cases


def test_urls(spark):
    urls = [
        "https://m/place/A+B/@10.5,106.25,17z/data=!3d1!4d2", "https://m/x!3d10.1!4d-106.2", "https://m/@95,10", "https://m/?cid=123_a",
        "https://m/data=!1s0x31:0xab!8m", "https://m/place/Ph%E1%BB%9F+B/@1,2",
    ]
    assert [tuple(v) if v else None for v in values(spark, urls, scan.url_coordinates)] == [
        (10.5, 106.25), (10.1, -106.2), None, None, None, (1.0, 2.0)]
    assert values(spark, urls, scan.url_place_id) == ["A+B", None, None, "123_a", "0x31:0xab", "Phở+B"]
    images = ["https://lh.googleusercontent.com/p/abc=w86-h114-k-no", "https://x/a.jpg", "https://maps.gstatic.com/i.png", "https://x/a/AB12"]
    assert values(spark, images, scan.photo_url) == ["https://lh.googleusercontent.com/p/abc", "https://x/a.jpg", None, None]


def test_stable_id_golden(spark):
    frame = spark.createDataFrame([("Stable Place", "1 Test Street", None)], "n string, a string, c struct<latitude:double,longitude:double>")
    got = frame.select(scan.stable_external_id(F.col("n"), F.col("a"), F.col("c"))).first()[0]
    assert got == "gmaps_b224bafe89d6892aebbffa15f1b1e2c5"


def test_labels_and_places(spark):
    labels = {"Quán cà phê": "coffee-shop", "Bánh mì": "snack", "Nhà hàng chay": "vegetarian", "Phở": "noodle", "Restaurant": "restaurant", "Gym": None}
    assert dict(zip(labels, values(spark, list(labels), scan.label_slug))) == labels
    spots = {"Quận 07, Ho Chi Minh City": ("Quận 7", "Ho Chi Minh City"), "Gò Vấp, HCM": ("Gò Vấp", "HCM"), "Nhà Bè, HCM": (None, "HCM"), "": (None, None)}
    got = zip(values(spark, list(spots), scan.district), values(spark, list(spots), scan.city))
    assert dict(zip(spots, got)) == spots
    assert values(spark, ["Ngon lắm đó", "very good", "123", None], scan.language) == ["vi", "en", None, None]
