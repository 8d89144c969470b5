"""Declared schemas; nothing is inferred."""

from __future__ import annotations

SCOPE = "struct<from_block:string,until_block:string,extra_blocks:array<string>>"
NORMS = f"ord int, norm_id string, short_name string, title string, aliases array<string>, rank string, jurisdiction string, legal_effect string, topics array<string>, scope {SCOPE}, scope_rationale string, application_date date"
BLOCK_INDEX = "norm_id string, ord int, block_id string, title string, updated_at date"
METADATA = "norm_id string, title string, rank string, entry_into_force date, eli_url string, consolidated_html_url string, repealed boolean"
PARAGRAPH = "struct<kind:string,text:string,css_class:string>"
VERSION = f"struct<vord:int,in_force_since:date,label_line:string,heading_lines:array<string>,paragraphs:array<{PARAGRAPH}>,notes:array<string>>"
BLOCKS = f"norm_id string, ord int, block_id string, block_type string, title string, expired_on date, versions array<{VERSION}>"
PRICING = "model string, input double, output double, cache_read double, cache_write double"

# What the enumerations may hold.
JURISDICTIONS = ("ES", "EU")
PARAGRAPH_KINDS = ("text", "heading", "table", "note")
PROVISION_KINDS = ("articulo", "disposicion_adicional", "disposicion_transitoria", "disposicion_derogatoria", "disposicion_final", "anexo")
CATEGORIES = ("single", "literal", "cross", "out_of_scope")
