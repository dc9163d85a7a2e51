"""Schemas of records, as DDL."""

DOCUMENT = "s3_key string, regulator string, s3_bucket string, title string, document_type string, document_subtype string, effective_date string, release_date string, source_url string, pdf_url string, row_id string, extra_metadata map<string,string>"
MANIFEST_ENTRY = f"{DOCUMENT}, ingested boolean, local_path string, error string, jurisdiction string, language string"
MANIFEST = f"version string, output_base string, regulators array<string>, documents array<struct<{MANIFEST_ENTRY}>>, count int, failed_count int, failed array<struct<s3_key string, regulator string, error string>>"
PAGES = "array<struct<page_number:int,text:string>>"
CHUNK = "chunk_id string, text string, document_id string, chunk_index int, total_chunks int, level string, section_number string, clause_number string, section_title string, chapter string, page_start int, page_end int, act_name string, effective_date string, amendment_info string, semantic_role string, parent_path string, regulator string, document_type string, document_subtype string, s3_key string, source_url string, local_path string, title string, jurisdiction string, metadata map<string,string>"
OBLIGATION = "array<struct<obligation_id:string,subject:string,modality:string,action:string,modality_detected:string,reference_anchor:string>>"
STATUS = "struct<status:string,message:string,reason:string>"
STRUCTURE = "document_metadata struct<title:string,regulator:string,jurisdiction:string>, nodes array<struct<id_path:string,node_type:string,label:string,title:string,numbering:array<string>,text:string,parent_id_path:string,page_start:int>>, relationships array<struct<source:string,target:string,type:string>>"
TRIAGE = "alert_class string, confidence string, priority string, primary_functions array<string>, secondary_functions array<string>, lines_of_defence array<int>, summary string, key_dates array<map<string,string>>, applicability array<string>, obligations_present boolean, thought_trace string"

# The ontology's vocabularies.
ENTITY_TYPES = ("Regulator", "Act", "Amendment", "Part", "Chapter", "Article", "Section", "Subsection", "Clause", "LegalDefinition", "Explanation", "Proviso", "Schedule", "Annex", "CrossReference", "EffectiveDate", "SourceDocument")
SEMANTIC_ROLES = ("definition", "obligation", "prohibition", "penalty", "exception", "proviso", "explanation", "procedure", "authority", "schedule", "other")
RELATION_TYPES = (
    "ACT_HAS_CHAPTER", "ACT_HAS_SECTION", "CHAPTER_HAS_SECTION", "SECTION_HAS_SUBSECTION", "SECTION_HAS_CLAUSE", "SUBSECTION_HAS_CLAUSE", "CLAUSE_HAS_SUBCLAUSE", "SECTION_HAS_EXPLANATION", "SECTION_HAS_PROVISO", "ACT_HAS_SCHEDULE",
    "SECTION_CONTAINS_DEFINITION", "DOCUMENT_HAS_PREAMBLE", "DOCUMENT_HAS_RECITAL", "DOCUMENT_HAS_PART", "DOCUMENT_HAS_ARTICLE", "DOCUMENT_HAS_SCHEDULE", "DOCUMENT_HAS_ANNEX", "PART_HAS_CHAPTER", "PART_HAS_ARTICLE", "SECTION_HAS_PARAGRAPH",
    "PARAGRAPH_HAS_POINT", "POINT_HAS_SUBPOINT", "CHAPTER_HAS_ARTICLE", "SCHEDULE_HAS_SECTION", "SCHEDULE_HAS_CHAPTER", "SCHEDULE_HAS_ARTICLE", "SCHEDULE_HAS_PARAGRAPH", "ANNEX_HAS_SECTION", "ANNEX_HAS_CHAPTER", "ANNEX_HAS_ARTICLE",
    "ACT_ISSUED_BY_REGULATOR", "AMENDS_ACT", "ACT_HAS_EFFECTIVE_DATE", "SECTION_HAS_EFFECTIVE_DATE", "CLAUSE_REFERENCES_SECTION", "CLAUSE_REFERENCES_ACT", "SECTION_REFERENCES_SECTION", "SECTION_REFERENCES_ACT", "ACT_SOURCE_DOCUMENT",
    "SECTION_SOURCE_PAGE", "CONTAINS",
)
MODALITIES = ("MUST", "MAY", "SHOULD", "REQUIRED", "MUST_NOT", "SHALL", "SHALL_NOT")
CLASSES = ("obligation", "non_obligation", "neutral")
