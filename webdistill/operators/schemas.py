"""Types of what the operators return."""

METADATA = (
    "struct<title string, description string, authors array<string>, site_name string, canonical_url string, image string, favicon string, published_time string, "
    "modified_time string, language string, direction string, section string, tags array<string>>"
)
METRICS = (
    "struct<text_chars bigint, word_count bigint, paragraph_count bigint, heading_count bigint, list_count bigint, list_item_count bigint, code_block_count bigint, table_count bigint, "
    "table_cell_count bigint, figure_count bigint, image_count bigint, link_count bigint, blockquote_count bigint, footnote_count bigint, math_count bigint, media_count bigint, "
    "link_density double, has_alphanumeric_text boolean, has_contextual_structure boolean>"
)
ERROR = "struct<kind string, message string, resource string, limit bigint>"
COVERAGE = "struct<category string, source_count int, result_count int, coverage double>"
NORMALIZATION = "struct<code_blocks int, footnote_references int, footnote_definitions int, math_expressions int, images int, tables int, flattened_layout_tables int>"
ATTEMPT = (
    "struct<strategy string, root string, source string, accepted boolean, rejection string, score double, "
    f"coverage double, categories array<{COVERAGE}>, normalization {NORMALIZATION}>"
)
CANDIDATE = "struct<field string, value string, source string, confidence int, ord int, key string>"
SELECTED = "struct<field string, value string, source string, confidence int, score int, ord int, selected boolean>"
PAGE = (
    f"struct<metadata {METADATA}, markdown string, html string, text string, metrics {METRICS}, kind string, diagnostics array<{ATTEMPT}>, "
    f"metadata_diagnostics array<{SELECTED}>, structured_data array<string>, error {ERROR}>"
).replace(": ", " ")
BLOCK = (
    "struct<op string, close boolean, level int, text string, href string, title string, src string, alt string, language string, ordered boolean, start bigint, header boolean, "
    "colspan int, rowspan int, align string, kind string, label string, checked boolean, leaf boolean, item_ord int, list_ord int, in_figure boolean>"
)
NODE = "struct<node_id int, parent_id int, pre int, subtree_end int, depth int, kind string, tag string, attrs map<string,string>, text string, text_from int, text_to int, body_pre int, body_end int, body_from int, body_to int>"
LINK = "struct<ord int, href string, text string, rel string>"
RANKED = (
    "struct<pre int, tag string, sources array<string>, prior double, readability double, word_count double, text_chars double, paragraph_count double, heading_count double, "
    "list_item_count double, code_block_count double, table_count double, figure_count double, image_count double, link_density double, link_text_chars double, digit_chars double, "
    "sentence_end_count double, comma_count double, protected_block_count double, positive_name double, negative_name double, utility_name double, score double>"
)
LOCATED = "struct<tag string, name string, agreement double>"
