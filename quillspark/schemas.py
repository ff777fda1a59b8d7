"""Schemas of the tables that operators take and give."""

BLOCKS = "doc_id string, page_num int, block_idx int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, block_type string"
FRAGMENTS = "doc_id string, page_num int, frag_idx int, y0 double, x0 double, text string"
TABLES = "doc_id string, page_num int, table_idx int, bbox array<double>, rows array<array<string>>"
OCR_PAGES = "doc_id string, page_num int, engine string, text string, avg_confidence double, words array<struct<text:string,conf:double>>"
CHUNKS = "document string, chunk_idx int, section string, text string, meta map<string,string>"
GROUND_TRUTH = (
    "source_pdf string, document_type string, num_pages int, fields struct<brand_name:string,generic_name:string,dosage_form:string,"
    "manufacturer_labeler:string,application_number:string,initial_us_approval:string,"
    "revision_dates:struct<prescribing_information:string,spl_document:string,medication_guide:string>,has_boxed_warning:boolean,"
    "boxed_warning_title:string,indication_summary:string,dosage_forms_strengths:string,ndc:string>, notes string"
)
EVAL_SET = "_readme string, questions array<struct<id:int,document:string,question:string,expected_phrase:string>>"
QA_SET = "id string, document string, question string, ground_truth string, field_type string"
SCAN_MANIFEST = (
    "documents array<struct<stem:string,brand_name:string,ground_truth:string,degradation:string,dpi:int,rotation_degrees:double,"
    "noise_blur:boolean,jpeg_quality:int,why_chosen:string>>"
)
