"""Settings and fixed tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "sentence"
    chunk_size: int = 512
    chunk_overlap: int = 64


#: What pages are chunked with where nothing is configured: the retrieval library's own defaults (fixed values).
LIBRARY_CHUNKS = ChunkConfig("sentence", 1024, 200)


@dataclass(frozen=True)
class RetrieverConfig:
    top_k: int = 5
    similarity_threshold: float = 0.3


MATCH_THRESHOLD = 0.75
MAX_DESKEW_ANGLE = 15.0
ROW_TOLERANCE = 2.0
PAGES_TO_SCAN = 2
ENGINES = ("tesseract", "paddleocr", "easyocr")
CONFIDENCE_SCALE = {"tesseract": 100.0}
#: Engines whose words without text or a whole confidence above zero are no words; their confidences are whole numbers.
FILTERED_ENGINES = ("tesseract",)

# Question phrases and the section headers they route to, in order of priority.
SECTION_ROUTES = (
    ("black box warning", "^WARNING:"),
    ("boxed warning", "^WARNING:"),
    ("contraindication", "^CONTRAINDICATIONS"),
    ("dosage", "^DOSAGE"),
    ("indicated", "^INDICATIONS AND USAGE"),
    ("used for", "^INDICATIONS AND USAGE"),
    ("adverse reaction", "^ADVERSE REACTIONS"),
    ("side effect", "^ADVERSE REACTIONS"),
    ("drug interaction", "^DRUG INTERACTIONS"),
)

# Brands and their documents, in order of priority.
DOCUMENTS = (
    ("CHANTIX", "20140820_2468ba8d-4c77-4ea0-88d8-b64497a72222"),
    ("LIPITOR", "20240627_a60cc18b-0631-4cf0-b021-9f52224ece65"),
    ("IBRANCE", "20260624_e0e6412f-50b4-4fd4-9364-62818d121a07"),
    ("XELJANZ", "20260329_68e3d6b2-7838-4d2d-a417-09d919b43e13"),
    ("PREVNAR 20", "20250720_d4e2cf51-e6a8-4103-bb1d-6120c6474ff8"),
    ("ZITHROMAX", "20250212_8d24bacb-feff-4c6a-b8df-625e1435387a"),
    ("BENEFIX", "20250227_85faa5bc-cee5-4ef1-8d80-bdbcb7eba1e4"),
    ("ELIQUIS", "20250504_e9481622-7cc6-418a-acb6-c5450daae9b0"),
    ("NORVASC", "20250607_abd6a2ca-40c2-485c-bc53-db1c652505ed"),
    ("ZOLOFT", "20250724_fda754f6-d0f3-4dce-a17a-927d64f912f7"),
    ("DEPO-PROVERA", "20251219_199cf13e-0859-4a73-9b45-e700d0cd1049"),
    ("VIAGRA", "20260213_0b0be196-0c62-461c-94f4-9a35339b4501"),
    ("PAXLOVID", "20260221_8a99d6d6-fd9e-45bb-b1bf-48c7f761232a"),
    ("NURTEC ODT", "20260607_9ef08e09-1098-35cc-e053-2a95a90a3e1d"),
)

# Fields that are scored as dates, fields that are not scored, and known gaps of one document.
DATE_FIELDS = ("initial_us_approval", "revision_dates.prescribing_information", "revision_dates.spl_document", "revision_dates.medication_guide")
EXCLUDED_FIELDS = ("revision_dates", "has_boxed_warning", "application_number", "ndc")
SCOPE_GAPS = (("IBRANCE", "manufacturer_labeler"),)

# Short names of embedding models.
EMBEDDING_MODELS = {
    "bge-base": "BAAI/bge-base-en-v1.5",
    "bge-small": "BAAI/bge-small-en-v1.5",
    "minilm": "sentence-transformers/all-MiniLM-L6-v2",
    "mpnet": "sentence-transformers/all-mpnet-base-v2",
}

# Degradation jobs (document, dpi, rotation in degrees, noise and blur, JPEG quality).
SCAN_JOBS = (
    ("20140820_2468ba8d-4c77-4ea0-88d8-b64497a72222", 200, 0.0, False, 90),
    ("20260624_e0e6412f-50b4-4fd4-9364-62818d121a07", 200, 0.0, False, 90),
    ("20240627_a60cc18b-0631-4cf0-b021-9f52224ece65", 130, 2.5, False, 75),
    ("20250410_a6cc97d8-252a-4527-a470-6d9e356342fd", 110, 1.2, True, 40),
)
