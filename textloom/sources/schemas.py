"""Fixed schemas of the tables that the operators read and write."""

RAW = "task_id STRING, text STRING"
MODULES = "text STRING, module_name STRING, task_id BIGINT, code_str_before_preprocessing STRING"
METADATA = "task_id STRING, code_name STRING, module_inst_list ARRAY<STRING>, error STRING, code_str STRING"
METADATA_MAP = "MAP<STRING, STRUCT<code_name: STRING, module_inst_list: ARRAY<STRING>, error: STRING, code_str: STRING>>"
LINES = "file STRING, line_number INT, content STRING"
CSV_LINES = "content STRING, line_number INT"
CLUSTER = "ARRAY<STRUCT<base_index: BIGINT, repo_name: STRING, path: STRING, copies: INT, is_extreme: BOOLEAN>>"
PROBLEMS = "task_id STRING, prompt STRING, canonical_solution STRING, test STRING"
DESCRIPTIONS = "task_id STRING, simple_description STRING, detail_description STRING, block_to_code_description STRING, block_global_to_code_description STRING"
SAMPLES = "task_id STRING, completion STRING"
RESULTS = "task_id STRING, completion STRING, result STRING, passed BOOLEAN"
PAIRS = "code STRING, description STRING"
SFT = "input STRING, output STRING, split STRING, length INT"
EMBEDDINGS = "Filename STRING, embedding ARRAY<DOUBLE>, Line_id INT, Text STRING"
CONTEXT = "Filename STRING, Filetype STRING, Summary STRING, Text STRING, Line_id INT"
BOOKKEEPING = (
    "name STRING, path STRING, genre STRING, block_summary ARRAY<STRING>, detailed_steps ARRAY<STRING>, module_header STRING, "
    "global_summary_high_level STRING, global_summary_detailed STRING, splitted_idx ARRAY<ARRAY<INT>>, summary_in_vecstore BOOLEAN, title_in_vecstore BOOLEAN"
)
COMMENT_REPLY = "comment_exist ARRAY<BOOLEAN>, comment ARRAY<STRING>, line_number ARRAY<INT>"
SUMMARY_REPLY = "usage STRING, summary STRING"
LOOKUP_REPLY = "function_exist BOOLEAN, function_name ARRAY<STRING>"
