"""Schemas of the flat fact and of the inputs it is recovered from."""

LOAD_LINE = (
    "source string, doc_id string, table_ord bigint, line_ord bigint, manufacturer string, cartridge string, "
    "bullet_weight_gr double, bullet_type string, bullet_id string, coal_in string, case_name string, primer string, "
    "barrel string, twist string, test_firearm string, source_url string, notes string, powder string, charge_gr double, "
    "charge_min_gr double, charge_max_gr double, velocity_fps double, velocity_min_fps double, is_max boolean, flags string"
)
WORDS = "doc_id string, page int, seq int, text string, x0 double, x1 double, top double"
LINES = "doc_id string, line_no int, line string"
SHEET_ROWS = "doc_id string, row_no int, cells array<string>"
LISTING_HTML = "source string, page_ord int, url string, html string"
DOCS = "doc_id string, cartridge string, item_name string, source_url string"
ROW = ("powder", "charge_gr", "charge_min_gr", "charge_max_gr", "velocity_fps", "velocity_min_fps", "is_max", "flags")
