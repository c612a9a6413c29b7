"""Fixed vocabulary of the catalog: lists, lookup tables and patterns.

Everything here is data, not logic.  The values are fixed: results only agree
with the system this catalog replaces when they are used unchanged.  They are
small (each table is far below a thousand rows), which is why the jobs may
inline them as literals or ship them as broadcast tables.
"""

from __future__ import annotations

# --- fixed values: provider codes -------------------------------------------
SCAN_PROVIDER = "google_maps_playwright"
RETIRED_PROVIDERS = ("fixture", "google_maps")
DEFAULT_CITY = "Ho Chi Minh City"

# --- fixed values: seed categories (name, slug, description) ------------------
CATEGORY_SEEDS = [
    ("Vietnamese", "vietnamese", "Vietnamese cuisine"),
    ("Coffee Shop", "coffee-shop", "Coffee, tea and light refreshments"),
    ("Vegetarian", "vegetarian", "Vegetarian food and beverages"),
    ("Noodle", "noodle", "Noodle-focused dishes"),
    ("Dessert", "dessert", "Sweet dishes and desserts"),
    ("Bún", "bun", "Bún and Vietnamese rice vermicelli dishes"),
    ("Cơm", "rice", "Rice dishes and everyday meals"),
    ("Ăn vặt", "snack", "Street snacks and small bites"),
    ("Đồ uống", "beverage", "Drinks, tea and refreshments"),
]

# --- fixed values: food attributes (code, name, normalized, dimension) --------
FOOD_ATTRIBUTES = [
    ("hot", "Nóng", "nong", "taste"),
    ("spicy", "Cay", "cay", "taste"),
    ("sweet", "Ngọt", "ngot", "taste"),
    ("salty", "Mặn", "man", "taste"),
    ("sour", "Chua", "chua", "taste"),
    ("creamy", "Béo", "beo", "taste"),
    ("crispy", "Giòn", "gion", "taste"),
    ("cool", "Mát", "mat", "taste"),
    ("fresh", "Tươi", "tuoi", "taste"),
    ("bold", "Đậm đà", "dam da", "taste"),
    ("light", "Thanh đạm", "thanh dam", "taste"),
    ("light-belly", "Nhẹ bụng", "nhe bung", "feel"),
    ("filling", "No lâu", "no lau", "feel"),
    ("snack", "Ăn vặt", "an vat", "feel"),
    ("full-meal", "Đầy bữa", "day bua", "feel"),
    ("beef", "Thịt bò", "thit bo", "ingredient"),
    ("chicken", "Thịt gà", "thit ga", "ingredient"),
    ("pork", "Thịt heo", "thit heo", "ingredient"),
    ("shrimp", "Tôm", "tom", "ingredient"),
    ("crab", "Cua", "cua", "ingredient"),
    ("fish", "Cá", "ca", "ingredient"),
    ("snail", "Ốc", "oc", "ingredient"),
    ("egg", "Trứng", "trung", "ingredient"),
    ("seafood", "Hải sản", "hai san", "ingredient"),
    ("vegetarian", "Chay", "chay", "ingredient"),
    ("grilled", "Nướng", "nuong", "method"),
    ("fried", "Chiên", "chien", "method"),
    ("steamed", "Hấp", "hap", "method"),
    ("street", "Đường phố", "duong pho", "method"),
]

# --- fixed values: words ignored when a search text is split into terms -------
SEARCH_STOP_WORDS = [
    "an", "cho", "co", "di", "gi", "gan", "minh", "muon", "nay", "nhe", "nhung",
    "quan", "tim", "va", "voi", "o", "mon", "theo", "dang", "bua", "buoi",
]

# --- fixed values: words that name a dish type -> category slug, in test order -
DISH_TYPE_ALIASES = [
    ("bánh mì", "snack"),
    ("bún", "bun"),
    ("mì / phở", "noodle"),
    ("mì", "noodle"),
    ("phở", "noodle"),
    ("cơm", "rice"),
    ("ăn vặt", "snack"),
    ("đồ uống", "beverage"),
]

# --- fixed values: words that name a category -> slug, in test order ----------
CATEGORY_ALIASES = [
    ("coffee-shop", "coffee-shop"),
    ("cà phê", "coffee-shop"),
    ("cafe", "coffee-shop"),
    ("coffee", "coffee-shop"),
    ("vegetarian", "vegetarian"),
    ("chay", "vegetarian"),
    ("italian", "italian"),
    ("món ý", "italian"),
    ("ẩm thực ý", "italian"),
    ("vietnamese", "vietnamese"),
    ("việt", "vietnamese"),
    ("phở", "noodle"),
    ("noodle", "noodle"),
    ("món việt", "vietnamese"),
    ("ẩm thực việt", "vietnamese"),
    ("bbq", "bbq"),
    ("nướng", "bbq"),
    ("sushi", "sushi"),
    ("pizza", "pizza"),
    ("lẩu", "hotpot"),
    ("hotpot", "hotpot"),
    ("hàn quốc", "korean"),
    ("korean", "korean"),
    ("hải sản", "seafood"),
    ("seafood", "seafood"),
    ("tráng miệng", "dessert"),
    ("dessert", "dessert"),
    ("kem", "dessert"),
    ("chè", "dessert"),
    ("bánh ngọt", "dessert"),
    ("bánh kem", "dessert"),
    ("sữa chua", "dessert"),
]

# --- fixed values: categories that may become a filter ------------------------
FILTERABLE_CATEGORIES = [
    "coffee-shop", "vegetarian", "vietnamese", "noodle", "dessert", "bun", "rice",
    "snack", "beverage",
]

# --- fixed values: districts --------------------------------------------------
NUMBERED_DISTRICTS = [
    "Quận 1", "Quận 2", "Quận 3", "Quận 4", "Quận 5", "Quận 6",
    "Quận 7", "Quận 8", "Quận 9", "Quận 10", "Quận 11", "Quận 12",
]
NAMED_DISTRICTS = [
    "Bình Thạnh", "Gò Vấp", "Phú Nhuận", "Tân Bình", "Tân Phú", "Bình Tân",
    "Thủ Đức", "Hóc Môn", "Củ Chi", "Bình Chánh", "Nhà Bè", "Cần Giờ",
]
DISTRICT_NAMES = NUMBERED_DISTRICTS + NAMED_DISTRICTS
# Order in which a location text is tested for a named district.
DISTRICT_INFERENCE_ORDER = [
    "Bình Thạnh", "Phú Nhuận", "Tân Bình", "Tân Phú", "Gò Vấp", "Bình Tân",
    "Thủ Đức", "Nhà Bè", "Bình Chánh", "Hóc Môn", "Củ Chi", "Cần Giờ",
]
# Aliases for numbered districts run from 12 down to 1, Vietnamese before English.
DISTRICT_ALIASES = [
    ("quận 12", "Quận 12"),
    ("district 12", "Quận 12"),
    ("quận 11", "Quận 11"),
    ("district 11", "Quận 11"),
    ("quận 10", "Quận 10"),
    ("district 10", "Quận 10"),
    ("quận 9", "Quận 9"),
    ("district 9", "Quận 9"),
    ("quận 8", "Quận 8"),
    ("district 8", "Quận 8"),
    ("quận 7", "Quận 7"),
    ("district 7", "Quận 7"),
    ("quận 6", "Quận 6"),
    ("district 6", "Quận 6"),
    ("quận 5", "Quận 5"),
    ("district 5", "Quận 5"),
    ("quận 4", "Quận 4"),
    ("district 4", "Quận 4"),
    ("quận 3", "Quận 3"),
    ("district 3", "Quận 3"),
    ("quận 2", "Quận 2"),
    ("district 2", "Quận 2"),
    ("quận 1", "Quận 1"),
    ("district 1", "Quận 1"),
    ("bình thạnh", "Bình Thạnh"),
    ("gò vấp", "Gò Vấp"),
    ("phú nhuận", "Phú Nhuận"),
    ("tân bình", "Tân Bình"),
    ("tân phú", "Tân Phú"),
    ("bình tân", "Bình Tân"),
    ("thủ đức", "Thủ Đức"),
    ("hóc môn", "Hóc Môn"),
    ("củ chi", "Củ Chi"),
    ("bình chánh", "Bình Chánh"),
    ("nhà bè", "Nhà Bè"),
    ("cần giờ", "Cần Giờ"),
]

# --- fixed values: taste words -> canonical taste, in removal order -----------
TASTE_ALIASES = [
    ("ngọt", "ngọt"),
    ("cay", "cay"),
    ("mặn", "mặn"),
    ("chua", "chua"),
    ("béo", "béo"),
    ("nóng", "nóng"),
    ("mát", "mát"),
    ("lạnh", "mát"),
    ("giòn", "giòn"),
    ("hấp", "hấp"),
    ("nướng", "nướng"),
    ("chiên", "chiên"),
    ("thanh đạm", "thanh đạm"),
    ("nhẹ bụng", "nhẹ bụng"),
    ("nhẹ", "nhẹ bụng"),
    ("no lâu", "no lâu"),
    ("đầy bữa", "đầy bữa"),
    ("đậm đà", "đậm đà"),
    ("tươi", "tươi"),
]

# --- fixed values: weather phrases -> comfort taste, in test order ------------
WEATHER_PHRASES = [
    ("trời mưa", "nóng"),
    ("mưa rét", "nóng"),
    ("trời lạnh", "nóng"),
    ("trời trở lạnh", "nóng"),
    ("lạnh buốt", "nóng"),
    ("se lạnh", "nóng"),
    ("mùa mưa", "nóng"),
    ("gió lạnh", "nóng"),
    ("trời đang nóng", "mát"),
    ("trời nắng nóng", "mát"),
    ("thời tiết nóng", "mát"),
    ("nắng nóng", "mát"),
    ("nóng bức", "mát"),
    ("nóng nực", "mát"),
    ("nắng gắt", "mát"),
    ("oi bức", "mát"),
    ("trời nóng", "mát"),
    ("trời nắng", "mát"),
    ("trời oi", "mát"),
]
COMFORT_SEMANTIC_TEXT = {"nóng": "món nóng ấm bụng", "mát": "món mát lạnh"}

# --- fixed values: filler removed from a request text -------------------------
FILLER_PHRASES = [
    "gần đây", "cho tôi", "cho mình", "món gì", "gì đó", "một món", "quán gì",
    "ở đâu", "gần nhà", "bình dân", "giá rẻ", "cao cấp", "hiện tại", "gợi ý",
]
FILLER_WORDS = [
    "tìm", "cho", "tôi", "mình", "muốn", "cần", "xin", "giúp", "gì", "đó", "nào",
    "một", "món", "quán", "quầy", "ngon", "nhất", "ạ", "nha", "nè", "nhé", "ơi",
    "đừng", "hay", "và", "có", "của", "tại", "ra", "để", "đi", "bữa", "gần", "đây",
    "khu", "vực", "ở", "ngay", "cạnh", "buổi", "sáng", "trưa", "chiều", "tối",
    "nay", "lúc", "giờ", "thêm", "nữa", "được", "không", "chỗ", "nơi", "xem", "ăn",
    "uống", "đồ", "vặt", "giá", "rẻ", "đắt", "xịn", "sang", "tiền", "đang", "hãy",
    "hiện", "bây", "giờ", "này",
]

# --- fixed values: words a supplied intent may not use as a taste -------------
NON_TASTE_WORDS = [
    "ngon", "ngon nhất", "ngon bổ rẻ", "sạch", "sạch sẽ", "chất lượng", "uy tín",
    "bổ", "đẹp", "gần", "tiện", "mát mẻ", "thân thiện", "chuẩn", "đúng chuẩn",
    "chuẩn vị", "nổi tiếng", "nức tiếng", "xịn", "sang", "quen", "đông", "vắng",
    "lạ", "độc lạ", "mới", "tươi ngon", "ngon miệng", "hợp", "đầy đủ", "review",
    "ngon tuyệt", "tuyệt", "ok", "đãi", "tiết kiệm", "phù hợp", "thích hợp",
    "thời tiết", "đang", "ngoài trời", "ngoại trời", "nhóm đông", "đông người",
    "hội bạn",
]

# --- fixed values: attribute words tested by substring ------------------------
ATTRIBUTE_WORDS = [
    ("quiet", ["quiet", "yên tĩnh"]),
    ("date-friendly", ["date", "hẹn hò"]),
    ("work-friendly", ["working", "work", "làm việc"]),
]

# --- fixed values: folded phrases that ask for places nearby ------------------
NEAR_ME_PHRASES = [
    "gan day", "gan toi", "gan minh", "gan nha", "gan cho nay", "gan cho toi",
    "gan vi tri cua toi", "gan vi tri hien tai", "quanh day", "quanh toi",
    "quanh khu nay", "quanh cho nay", "xung quanh", "o day", "ngay day",
    "ngay gan day", "canh day", "canh nha", "canh cho toi", "tai vi tri cua toi",
    "tai cho toi",
]

# --- fixed values: area words that make a scanned name an area card -----------
AREA_WORDS = [
    "thanh pho", "city", "district", "quan", "phuong", "ward", "tinh", "province",
    "huyen", "county",
]

# --- fixed values: category labels that are not food --------------------------
NON_FOOD_LABEL_WORDS = [
    "benh vien", "hospital", "phong kham", "clinic", "medical", "nha khoa",
    "dentist", "dental", "nha thuoc", "pharmacy", "karaoke", "ktv", "spa",
    "massage", "nails", "hair", "barber", "salon", "cat toc", "tattoo", "piercing",
    "trang trai", "nong trai", "nong truong", "nong san", "nong nghiep", "farm",
    "sieu thi", "supermarket", "mall", "market", "cho", "tap hoa", "truong",
    "school", "university", "dai hoc", "ngan hang", "bank", "van phong", "chua",
    "nha tho", "temple", "church", "pagoda", "hoi nghi", "yen tiec", "convention",
    "wedding", "su kien", "cay xang", "gas station", "sua xe", "rua xe",
    "car wash", "garage", "khach san", "hotel", "resort", "homestay", "nha nghi",
    "thu y", "veterinarian", "pet", "gym", "fitness", "phong tap", "hoa",
    "flower", "florist", "cay canh", "dien thoai", "may tinh", "electronics",
    "bat dong san", "real estate", "chung cu",
]

# --- fixed values: names that are not food; "^" anchors at the start, "$" at the
# --- end, every bare end is a whole-word end ----------------------------------
NON_FOOD_NAME_PATTERNS = [
    "^cho", "^benh vien", "^nha khoa", "^trung tam y te", "^phong kham",
    "^karaoke", "ktv", "farm", "trang trai", "nong trai", "nong truong",
    "nong san", "^da dong cua", "khong ten", "^go!",
    "^trung tam (hoi nghi|yen tiec|su kien)",
    "^(nha be|binh chanh|can gio|cu chi|hoc mon|thu duc)$",
]
ADDRESS_ONLY_WORDS = ["phuong", "quan", "thanh pho"]

# --- fixed values: catalog junk rules (prefixes, whole words, exact names) ----
JUNK_NAME_PREFIXES = [
    "benh vien", "nha khoa", "trung tam y te", "phong kham", "karaoke", "cho ",
    "da dong cua", "go!", "trung tam hoi nghi", "trung tam yen tiec",
    "trung tam su kien",
]
JUNK_NAME_WORDS = [
    "farm", "trang trai", "nong trai", "nong truong", "nong san", "khong ten",
]
JUNK_NAMES = ["nha be"]
JUNK_ADDRESS_PARTS = [", phuong ", "quan ", "thanh pho "]
AREA_CARD_NAMES = ["thành phố hồ chí minh", "ho chi minh city"]

# --- fixed values: scanned category label -> slug, first rule that hits wins --
# A leading "^" anchors the words at the start of the label.
LABEL_RULES = [
    ("dessert", ["banh kem", "banh ngot", "sua chua", "dessert", "tiramisu",
                 "mousse", "bakery", "trai cay", "trang mieng", "ang ngot"]),
    ("snack", ["banh mi", "an vat", "street food", "food truck", "fast food",
               "banh xeo", "goi cuon", "snack"]),
    ("bun", ["bun cha", "bun bo", "bun rieu", "bun thit nuong", "bun oc", "bun ca",
             "bun gan", "bun"]),
    ("noodle", ["pho", "hu tieu", "mi quang", "mi xao", "mi ga", "banh canh",
                "noodle", "my", "mi"]),
    ("rice", ["com suon", "com tam", "com ga", "com rang", "com thap cam",
              "com bo", "com chay", "rice", "^com"]),
    ("beverage", ["tra sua", "tra chanh", "sinh to", "nuoc ep", "smoothie",
                  "juice", "bubble tea", "do uong", "drink"]),
    ("coffee-shop", ["ca phe", "coffee", "cafe", "capuchino", "latte", "espresso"]),
    ("vegetarian", ["chay", "vegan", "vegetarian"]),
    ("vietnamese", ["vietnamese", "quan an viet nam", "mon viet"]),
]
LABEL_SLUG_ALIASES = {
    "coffee": "coffee-shop",
    "cafe": "coffee-shop",
    "restaurant": "restaurant",
    "vietnamese-restaurant": "vietnamese",
    "quan-an-viet-nam": "vietnamese",
    "vietnamese-food": "vietnamese",
}

# --- fixed values: place-name category rules (slug, confidence, words) --------
# "^" anchors at the start; "(?<!banh )" keeps its look-behind meaning.
NAME_RULES = [
    ("coffee-shop", 0.95, ["ca phe", "coffee", "cafe", "capuchino", "latte",
                           "espresso"]),
    ("beverage", 0.9, ["tra sua", "tra chanh", "sinh to", "nuoc ep", "smoothie",
                       "juice"]),
    ("vegetarian", 0.95, ["chay", "vegan", "vegetarian"]),
    ("dessert", 0.9, ["banh kem", "banh ngot", "sua chua", "dessert", "tiramisu",
                      "mousse"]),
    ("bun", 0.85, ["bun"]),
    ("noodle", 0.85, ["pho", "hu tieu", "mi quang", "mi xao", "mi ga", "banh canh",
                      "(?<!banh )mi", "noodle"]),
    ("rice", 0.9, ["^com", "com tam", "com rang", "com ga", "com suon",
                   "com thap cam", "com bo"]),
    ("snack", 0.85, ["banh mi", "banh xeo", "banh cuon", "banh bao", "goi cuon",
                     "cha gio", "banh trang tron", "bot chien", "an vat",
                     "street food"]),
    ("vietnamese", 0.8, ["mon viet", "an viet", "vietnamese", "com viec"]),
]
CATEGORY_CONFIDENCE_FLOOR = 0.75

# --- fixed values: dish lexicon (normalized, display, attribute codes) --------
DISH_LEXICON = [
    ("pho bo", "Phở bò", ["hot", "beef"]),
    ("pho ga", "Phở gà", ["hot", "chicken"]),
    ("pho tai", "Phở tái", ["hot", "beef"]),
    ("pho chin", "Phở chín", ["hot", "beef"]),
    ("bun bo hue", "Bún bò Huế", ["hot", "spicy", "beef", "filling"]),
    ("bun rieu", "Bún riêu", ["hot", "spicy", "crab", "filling"]),
    ("bun cha", "Bún chả", ["grilled", "pork", "street"]),
    ("bun oc", "Bún ốc", ["hot", "snail", "filling"]),
    ("bun ga", "Bún gà", ["hot", "chicken", "filling"]),
    ("bun ca", "Bún cá", ["hot", "fish", "filling"]),
    ("bun thit nuong", "Bún thịt nướng", ["grilled", "sweet", "pork", "filling"]),
    ("bun mam", "Bún mắm", ["hot", "salty", "bold", "seafood"]),
    ("hu tieu nam vang", "Hủ tiếu Nam Vang", ["hot", "pork", "shrimp", "filling"]),
    ("hu tieu mi", "Hủ tiếu mì", ["hot", "filling"]),
    ("hu tieu ga", "Hủ tiếu gà", ["hot", "chicken", "filling"]),
    ("mi quang", "Mì Quảng", ["hot", "pork", "shrimp", "filling"]),
    ("mi xao gion", "Mì xào giòn", ["fried", "crispy", "pork", "shrimp", "filling"]),
    ("mi ga", "Mì gà", ["hot", "chicken", "filling"]),
    ("mi vit tim", "Mì vịt tiềm", ["hot"]),
    ("banh mi thit", "Bánh mì thịt", ["street", "pork", "filling"]),
    ("banh mi trung", "Bánh mì trứng", ["street", "egg"]),
    ("banh mi chao", "Bánh mì chảo", ["street", "fried", "pork", "egg", "filling"]),
    ("banh xeo", "Bánh xèo", ["street", "fried", "crispy", "pork", "shrimp"]),
    ("banh cuon", "Bánh cuốn", ["steamed", "light", "pork"]),
    ("banh canh", "Bánh canh", ["hot", "filling"]),
    ("banh trang tron", "Bánh tráng trộn", ["street", "snack", "spicy"]),
    ("banh bao", "Bánh bao", ["steamed", "snack", "pork", "filling"]),
    ("banh bot chien", "Bánh bột chiên", ["street", "fried", "crispy", "snack"]),
    ("banh tieu", "Bánh tiêu", ["sweet", "snack"]),
    ("banh flan", "Bánh flan", ["sweet", "cool", "snack"]),
    ("banh kem", "Bánh kem", ["sweet", "snack"]),
    ("com tam", "Cơm tấm", ["grilled", "pork", "filling"]),
    ("com rang", "Cơm rang", ["fried", "filling"]),
    ("com ga", "Cơm gà", ["fried", "chicken", "filling"]),
    ("com suon", "Cơm sườn", ["grilled", "pork", "filling"]),
    ("com thap cam", "Cơm thập cẩm", ["pork", "filling"]),
    ("com bo luc lac", "Cơm bò lúc lắc", ["beef", "filling"]),
    ("com hen", "Cơm hến", ["light", "fresh", "filling"]),
    ("com chay", "Cơm chay", ["vegetarian", "light"]),
    ("goi cuon", "Gỏi cuốn", ["fresh", "light", "pork", "shrimp"]),
    ("cha gio", "Chả giò", ["fried", "crispy", "pork"]),
    ("nem ran", "Nem rán", ["fried", "crispy", "pork"]),
    ("nem nuong", "Nem nướng", ["grilled", "sweet", "pork", "street"]),
    ("chao ga", "Cháo gà", ["hot", "light-belly", "chicken"]),
    ("chao long", "Cháo lòng", ["hot", "light-belly"]),
    ("xoi ga", "Xôi gà", ["street", "chicken", "filling"]),
    ("xoi man", "Xôi mặn", ["street", "filling"]),
    ("lau bo", "Lẩu bò", ["hot", "beef", "filling"]),
    ("lau ga", "Lẩu gà", ["hot", "chicken", "filling"]),
    ("lau tom", "Lẩu tôm", ["hot", "seafood", "shrimp", "filling"]),
    ("lau oc", "Lẩu ốc", ["hot", "snail", "filling"]),
    ("ga nuong", "Gà nướng", ["grilled", "chicken"]),
    ("suon nuong", "Sườn nướng", ["grilled", "pork"]),
    ("bo nuong", "Bò nướng", ["grilled", "beef"]),
    ("sua chua nep cam", "Sữa chua nếp cẩm", ["sweet", "cool", "snack"]),
    ("che ba mau", "Chè ba màu", ["sweet", "cool", "snack"]),
    ("che dau xanh", "Chè đậu xanh", ["sweet", "cool", "snack"]),
    ("tra sua tran chau", "Trà sữa trân châu", ["sweet", "cool", "snack"]),
    ("ca phe sua da", "Cà phê sữa đá", ["sweet", "cool"]),
    ("ca phe den", "Cà phê đen", ["cool"]),
    ("nuoc mia", "Nước mía", ["sweet", "cool", "fresh"]),
    ("sinh to xoai", "Sinh tố xoài", ["sweet", "cool", "fresh"]),
]
# Longest phrase in the lexicon, in words.
LEXICON_MAX_WORDS = 4
DISH_CONFIDENCE_NAME = 0.95
DISH_CONFIDENCE_MANY_REVIEWS = 0.9
DISH_CONFIDENCE_ONE_REVIEW = 0.7
ATTRIBUTE_CONFIDENCE = 0.9
PROFILE_CATEGORY_CONFIDENCE = 0.8

# --- fixed values: provenance tags written by the enrichment jobs -------------
ENRICHMENT_MODEL = "category:rules:v1;dish:lexicon:v1;attribute:rules:v1"
ENRICHMENT_RUN_TYPE = "category+dish+attribute"

# --- fixed values: relative review dates --------------------------------------
REVIEW_UNIT_SECONDS = {
    "minute": 60, "minutes": 60, "phút": 60,
    "hour": 3600, "hours": 3600, "giờ": 3600,
    "day": 86400, "days": 86400, "ngày": 86400,
    "week": 604800, "weeks": 604800, "tuần": 604800,
    "month": 2592000, "months": 2592000, "tháng": 2592000,
    "year": 31536000, "years": 31536000, "năm": 31536000,
}
REVIEW_NUMBER_WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "vài": 2, "một": 1,
    "hai": 2, "ba": 3, "bốn": 4, "năm": 5, "sáu": 6, "bảy": 7, "tám": 8,
    "chín": 9, "mười": 10,
}
REVIEW_DAY_WORDS = {"hôm nay": 0, "today": 0, "hôm qua": 1, "yesterday": 1}
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
]

# --- fixed values: image URLs that are not photos of a place ------------------
BLOCKED_IMAGE_PARTS = [
    "/maps/vt/", "streetviewpixels", "googlesyndication", "google.com/maps",
    "gstatic.com", "googleusercontent.com/googlelogo", "/a-/ALV-",
]
AVATAR_URL_PATTERN = r"/a/[^/]+[0-9]+$"
IMAGE_CDN_HOST = "googleusercontent.com"
MAX_IMAGE_URL_LENGTH = 2000
MAX_REVIEW_COUNT = 1_000_000

# --- fixed values: default query terms of the coverage plan -------------------
DEFAULT_PLAN_QUERIES = [
    "quán ăn", "nhà hàng", "quán cà phê", "món Việt", "bún phở", "cơm",
    "hủ tiếu mì", "bánh mì", "quán chay", "lẩu", "nướng BBQ", "hải sản",
    "món Huế", "món Nhật", "món Hàn", "pizza", "tráng miệng",
]

# --- fixed values: price phrases ----------------------------------------------
PRICE_PHRASES = {1: "bình dân", 2: "trung bình", 3: "khá cao", 4: "cao cấp"}

# --- fixed values: search document --------------------------------------------
DOCUMENT_TEMPLATE = "v3"
DOCUMENT_MAX_CHARS = 8000
DOCUMENT_REVIEWS = 4
DOCUMENT_REVIEW_CHARS = 110
PROFILE_MAX_CHARS = 1500

# --- fixed values: map window (south, west, north, east) ----------------------
MAP_BOUNDS = (10.55, 106.25, 11.25, 107.05)

# --- fixed values: allowed enum values ----------------------------------------
PLACE_STATUSES = ["active", "temporarily_closed", "permanently_closed", "unknown"]
