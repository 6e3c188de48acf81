"""Schemas of the graph and its tables. Ids are strings everywhere; nothing is inferred."""

from __future__ import annotations

TRIPLE = "s string, p string, o string, o_kind string, o_datatype string, o_lang string, source string"
TRIPLE_KEY = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]
NODE = (
    "id string, types array<string>, name string, description string, element_text string, source_section string, part_of string, "
    "elaborates string, has_element array<string>, has_example array<string>, jurisdiction string, sector string, specificity string, "
    "version string, publisher string, license string, date_published string"
)
FRAGMENT = "ordinal int, text string, node_type string"
FRAGMENT_INDEX = "parent_id string, subnode_id string, ordinal int, node_type string"
CHECK = "framework string, check string, severity string, message string, details map<string,string>"
SUMMARY = (
    "framework_slug string, framework_name string, framework_type string, jurisdiction string, organizing_unit_count long, element_count_strict long, "
    "element_count_with_examples long, example_count long, elements_per_organizing_unit_strict double, elements_per_organizing_unit_with_examples double, license string"
)
