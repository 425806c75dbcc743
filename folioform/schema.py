"""Explicit schemas and fixed vocabularies of the interchange model. No schema is ever inferred."""

from __future__ import annotations

REF = "struct<book:string,chapter:int,verse:int,chapter_end:int,verse_end:int,sub_verse:string,osis_id:string>"
TOKEN = "struct<id:string,idx:int,char_start:int,char_end:int,text:string,type:string,lemma:string,strongs:array<string>,morphology:string>"

CORPORA = "corpus_id string, version string, module_type string, versification string, language string, title string, description string, publisher string, rights string, source_format string, source_hash string, loss_class string, attributes map<string,string>"
DOCUMENTS = "corpus_id string, doc_id string, title string, doc_order int, attributes map<string,string>"
BLOCKS = "corpus_id string, doc_id string, doc_order int, block_id string, sequence int, book string, chapter int, verse int, verse_end int, text string, raw_markup string"
SPANS = "corpus_id string, doc_id string, block_id string, span_id string, type string, start_anchor string, end_anchor string, start_byte int, end_byte int"
ANNOTATIONS = "corpus_id string, doc_id string, annotation_id string, span_id string, type string, value string, confidence double, source string"
CROSSREFS = f"id string, source_ref {REF}, target_ref {REF}, type string, label string, notes string, confidence double, source string"
MAPPINGS = "table_id string, from_system string, to_system string, book string, chapter int, verse int, to_book string, to_chapter int, to_verse int, type string, note string"
TRANSCRIPT = "t string, seq bigint, engine_id string, plugin_id string, plugin_version string, module string, key string, profile string, sha256 string, blake3 string, bytes bigint, message string, attributes map<string,string>"

#: Fixed values of the enumerations.
MODULE_TYPES = ["BIBLE", "COMMENTARY", "DICTIONARY", "GENBOOK", "DEVOTIONAL"]
SPAN_TYPES = ["VERSE", "CHAPTER", "PARAGRAPH", "POETRY_LINE", "QUOTE", "RED_LETTER", "NOTE", "FOOTNOTE", "CROSS_REF", "SECTION", "TITLE", "DIVINE_NAME", "EMPHASIS", "FOREIGN"]
ANNOTATION_TYPES = ["STRONGS", "MORPHOLOGY", "LEMMA", "GLOSS", "FOOTNOTE", "CROSS_REF", "VARIANT", "COMMENT"]
TOKEN_TYPES = ["word", "punctuation", "whitespace"]
LOSS_CLASSES = ["L0", "L1", "L2", "L3", "L4"]
MAPPING_TYPES = ["exact", "split", "merge", "shift", "missing", "added"]
CROSSREF_TYPES = ["quotation", "allusion", "parallel", "prophecy", "typology", "general"]
EVENT_TYPES = ["ENGINE_INFO", "MODULE_DISCOVERED", "KEY_ENUM", "ENTRY_RENDERED", "WARN", "ERROR"]
#: Fixed order of the 66 book ids; the last 27 are the New Testament.
BOOKS = """Gen Exod Lev Num Deut Josh Judg Ruth 1Sam 2Sam 1Kgs 2Kgs 1Chr 2Chr Ezra Neh Esth Job Ps Prov Eccl Song Isa Jer Lam Ezek Dan Hos Joel
Amos Obad Jonah Mic Nah Hab Zeph Hag Zech Mal Matt Mark Luke John Acts Rom 1Cor 2Cor Gal Eph Phil Col 1Thess 2Thess 1Tim 2Tim Titus Phlm Heb Jas
1Pet 2Pet 1John 2John 3John Jude Rev""".split()
NEW_TESTAMENT = BOOKS[39:]
