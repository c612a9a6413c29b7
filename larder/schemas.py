"""Declared schemas, as DDL.  NULL always means "not observed"."""

from __future__ import annotations

TABLES = {
    "location": (
        "id string, address_line string, ward string, district string, city string, "
        "country_code string, postal_code string, formatted_address string, lat double, "
        "lon double, created_at timestamp, updated_at timestamp"
    ),
    "place": (
        "id string, name string, normalized_name string, description string, "
        "location_id string, phone string, website_url string, price_level int, "
        "rating decimal(2,1), review_count int, status string, semantic_profile string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "category": (
        "id string, name string, slug string, parent_id string, description string, "
        "is_active boolean"
    ),
    "data_source": (
        "id string, code string, name string, base_url string, is_active boolean"
    ),
    "place_source": (
        "id string, place_id string, data_source_id string, external_id string, "
        "source_url string, source_name string, source_rating decimal(2,1), "
        "source_review_count int, raw_data string, first_seen_at timestamp, "
        "last_seen_at timestamp, status string"
    ),
    "place_category": (
        "place_id string, category_id string, source string, confidence decimal(4,3), "
        "updated_at timestamp"
    ),
    "dish": (
        "id string, place_id string, name string, normalized_name string, "
        "description string, price_amount decimal(12,2), currency_code string, "
        "is_popular boolean, status string, source string, confidence double"
    ),
    "review": (
        "id string, place_id string, place_source_id string, external_review_id string, "
        "rating decimal(2,1), content string, reviewed_at timestamp, language_code string, "
        "is_visible boolean"
    ),
    "image": (
        "id string, place_id string, place_source_id string, url string, alt_text string, "
        "sort_order int, is_cover boolean, status string"
    ),
    "hours": (
        "id string, place_id string, day_of_week int, opens_min int, closes_min int, "
        "is_closed boolean, spans_next_day boolean"
    ),
    "crawl_run": (
        "id string, data_source_id string, job_type string, target string, status string, "
        "started_at timestamp, finished_at timestamp, records_found int, "
        "records_processed int, error_message string"
    ),
    "processing_record": (
        "id string, crawl_run_id string, place_source_id string, external_id string, "
        "stage string, status string, attempt_count int, error_details string, "
        "processed_at timestamp"
    ),
    "vector": (
        "id string, place_id string, embedding array<float>, model string, "
        "content_hash string, created_at timestamp"
    ),
    "food_attribute": (
        "id string, code string, name string, normalized string, dimension string, "
        "is_active boolean"
    ),
    "dish_attribute": (
        "dish_id string, attribute_id string, source string, confidence decimal(4,3)"
    ),
}

RUN_LOG = (
    "run_type string, model string, params string, status string, started_at timestamp, "
    "finished_at timestamp, places_scanned long, categories_applied long, "
    "dishes_applied long, attributes_applied long, embeddings_applied long, "
    "failure_message string"
)

# A raw list item as landed by a scan, before any field is interpreted.
RAW_SCAN = (
    "scan_id string, position int, query string, scan_location string, city string, "
    "district string, collected_at string, name string, rating_text string, "
    "review_text string, address string, category string, url string, "
    "images array<struct<url:string,alt_text:string>>"
)
# What a detail panel adds to a list item.
RAW_DETAIL = (
    "scan_id string, url string, name string, review_text string, phone_href string, "
    "phone_text string, website string, address string, price_texts array<string>, "
    "images array<struct<url:string,alt_text:string>>, "
    "reviews array<struct<id:string,author:string,rating_text:string,content:string,date:string>>"
)

SOURCE_RECORD = (
    "provider_code string, external_id string, source_url string, collected_at string, "
    "name string, address string, district string, city string, country_code string, "
    "coordinates struct<latitude:double,longitude:double>, phone string, "
    "website_url string, "
    "opening_hours array<struct<day_of_week:int,opens_at:string,closes_at:string,"
    "is_closed:boolean,spans_next_day:boolean>>, "
    "categories array<string>, price_level double, rating double, review_count double, "
    "images array<struct<url:string,alt_text:string,is_cover:boolean,sort_order:int>>, "
    "dishes array<struct<name:string,description:string,price_amount:double,"
    "currency_code:string,is_popular:boolean>>, "
    "reviews array<struct<external_review_id:string,rating:double,content:string,"
    "reviewed_at:string,language_code:string>>, "
    "source_metadata string"
)

# One search per row.  Only `request_id` is required; jobs add the rest as NULL.
REQUEST = {
    "request_id": "string", "query": "string", "category": "string",
    "dish_types": "array<string>", "tastes": "array<string>", "city": "string",
    "district": "string", "min_rating": "double", "price_level": "int",
    "latitude": "double", "longitude": "double", "radius_m": "double",
    "open_now": "boolean", "as_of": "timestamp", "sort": "string", "limit": "int",
    "offset": "int", "after_updated_at": "timestamp", "after_id": "string",
    "embedding": "array<float>", "model": "string",
}
