"""Schemas of what the sources read and the sinks write."""

CHUNK = (
    "paper_id string, chunk_type string, chunk_id string, title string, authors string, year string, doi string, source_file string, "
    "content string, word_count int, figure_id string, image_path string, caption string, confidence string"
)
PAGE = "page_number int, text string, word_count int, has_figures boolean, extraction_method string"
FIGURE = "figure_id string, page_number int, image_path string, caption string, width_px int, height_px int"
METADATA = "struct<title:string,author:string,doi:string,year:string,source:string>"
MANIFEST = (
    f"pdf_path string, paper_id string, metadata {METADATA}, extraction_method string, quality_score double, page_count int, word_count int, "
    "pages array<struct<page_number:int,word_count:int,has_figures:boolean,extraction_method:string>>, "
    "figures array<struct<figure_id:string,page_number:int,image_path:string,caption:string,width_px:int,height_px:int>>"
)
MESSAGE = "message_id bigint, session_id string, turn_no int, role string, message string, category string, sent_at timestamp, received_at timestamp"
EXTRACTED = "path string, page_number int, text string, word_count int, has_figures boolean, error string"
