"""DuckDB SQL that gives the same rows as the registered queries.

The SQL is written on its own, from the meaning of each operator: plain window functions
over whole tables, no buckets, no salts.
"""

from __future__ import annotations

from codeprep import config
from codeprep.functions.text import TOKEN_PATTERN
from registry.models import MODEL_VERSION
from registry.queries import COHORT, DESCRIPTIONS, TIMESTAMP, VOCABULARY

# The code points Python treats as blank, for RE2, whose ``\s`` covers fewer.
WHITESPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PROMPT = f"'{config.INSTRUCTION}' || chr(10) || chr(10) || "
LENGTH = config.DEFAULT_MAX_LENGTH

# Named parts; each lists the parts it builds on.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "notes": (
        (),
        """SELECT d.doc_id AS note_pk, o.o_custkey AS subject_id, o.o_orderkey AS hadm_id,
             CASE WHEN d.lang = 'en' THEN 'Discharge summary' ELSE 'Radiology' END AS category,
             d.text
           FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id // 2""",
    ),
    "notes_iv": (
        (),
        """SELECT o.o_custkey || '-DS-' || d.doc_id AS note_id, o.o_custkey AS subject_id,
             o.o_orderkey AS hadm_id,
             CASE WHEN d.lang = 'en' THEN 'DS' ELSE 'RR' END AS note_type, d.text
           FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id // 2""",
    ),
    "diagnoses": (
        (),
        """SELECT o.o_custkey AS subject_id, l.l_orderkey AS hadm_id, l.l_linenumber AS seq_num,
             lpad(l.l_partkey::VARCHAR, 5, '0') AS code
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
           WHERE l.l_linestatus = 'F'""",
    ),
    "procedures": (
        (),
        """SELECT o.o_custkey AS subject_id, l.l_orderkey AS hadm_id, l.l_linenumber AS seq_num,
             lpad(l.l_partkey::VARCHAR, 5, '0') AS code
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
           WHERE l.l_linestatus = 'O'""",
    ),
    "patients": (
        (),
        """SELECT c_custkey AS subject_id,
             CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM customer""",
    ),
    "discharge": (("notes",), "SELECT * FROM notes WHERE category = 'Discharge summary'"),
    "discharge_iv": (("notes_iv",), "SELECT * FROM notes_iv WHERE note_type = 'DS'"),
    "cohort": (
        ("discharge",),
        f"SELECT DISTINCT subject_id FROM discharge ORDER BY subject_id LIMIT {COHORT}",
    ),
    "dg": (
        ("diagnoses",),
        """SELECT subject_id, hadm_id, list(code ORDER BY seq_num, code) AS codes
           FROM diagnoses GROUP BY subject_id, hadm_id""",
    ),
    "pg": (
        ("procedures",),
        """SELECT subject_id, hadm_id, list(code ORDER BY seq_num, code) AS codes
           FROM procedures GROUP BY subject_id, hadm_id""",
    ),
    "lists": (
        ("dg", "pg"),
        """SELECT dg.subject_id, dg.hadm_id, dg.codes AS d, coalesce(pg.codes, []) AS p,
             list_concat(dg.codes, coalesce(pg.codes, [])) AS a
           FROM dg LEFT JOIN pg ON dg.subject_id = pg.subject_id AND dg.hadm_id = pg.hadm_id""",
    ),
    "fact": (
        ("discharge", "lists", "patients"),
        """SELECT row_number() OVER (ORDER BY n.subject_id, n.hadm_id, n.note_pk) AS row_id,
             n.*, l.d, l.p, l.a, t.gender
           FROM discharge n
           JOIN lists l ON n.subject_id = l.subject_id AND n.hadm_id = l.hadm_id
           LEFT JOIN patients t ON n.subject_id = t.subject_id""",
    ),
    "fact_iv": (
        ("discharge_iv", "lists", "patients"),
        """SELECT row_number() OVER (ORDER BY n.subject_id, n.hadm_id, n.note_id) AS row_id,
             n.*, l.d, l.p, l.a, t.gender
           FROM discharge_iv n
           JOIN lists l ON n.subject_id = l.subject_id AND n.hadm_id = l.hadm_id
           LEFT JOIN patients t ON n.subject_id = t.subject_id""",
    ),
    "shares": (
        ("fact",),
        """SELECT trunc(count(*) * 0.8::DOUBLE)::BIGINT AS train_rows,
             trunc(count(*) * 0.1::DOUBLE)::BIGINT AS val_rows FROM fact""",
    ),
    "labelled": (
        ("fact", "shares"),
        """SELECT f.*, CASE WHEN row_id <= train_rows THEN 'train'
             WHEN row_id <= train_rows + val_rows THEN 'val' ELSE 'test' END AS split
           FROM fact f, shares""",
    ),
    "examples": (
        ("labelled",),
        f"""SELECT row_id, split, text,
              {PROMPT} text AS prompt,
              array_to_string(list_transform(a, lambda c: 'ICD-9:' || c), ', ') AS completion
            FROM labelled WHERE length(text) > 0 AND len(a) > 0""",
    ),
    "vocab": (
        (),
        f"""SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id
            FROM (SELECT token, count(*) AS n
                  FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS token
                        FROM documents)
                  GROUP BY token ORDER BY n DESC, token LIMIT {VOCABULARY})""",
    ),
    "causal_words": (
        ("examples",),
        f"""SELECT split, row_id,
              regexp_extract_all(prompt || completion, '{TOKEN_PATTERN}')[1:{LENGTH}] AS words
            FROM examples""",
    ),
    "causal_ids": (
        ("causal_words", "vocab"),
        """SELECT w.split, w.row_id,
             coalesce(list(coalesce(v.token_id, 1) ORDER BY pos)
               FILTER (WHERE pos IS NOT NULL), []) AS ids
           FROM (SELECT split, row_id, unnest(words) AS token,
                   generate_subscripts(words, 1) AS pos FROM causal_words) w
           LEFT JOIN vocab v ON w.token = v.token GROUP BY w.split, w.row_id""",
    ),
    "train_vocab": (
        ("examples",),
        f"""SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id
            FROM (SELECT token, count(*) AS n
                  FROM (SELECT unnest(regexp_extract_all(prompt || completion, '{TOKEN_PATTERN}'))
                          AS token FROM examples WHERE split = 'train')
                  GROUP BY token ORDER BY n DESC, token LIMIT {VOCABULARY})""",
    ),
    "val_ids": (
        ("examples", "train_vocab"),
        f"""SELECT w.row_id, row_number() OVER (ORDER BY w.row_id) - 1 AS id,
              list(coalesce(v.token_id, 1) ORDER BY pos) AS ids
            FROM (SELECT row_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos
                  FROM (SELECT row_id, regexp_extract_all(prompt || completion,
                          '{TOKEN_PATTERN}') AS words FROM examples WHERE split = 'val')) w
            LEFT JOIN train_vocab v ON w.token = v.token GROUP BY w.row_id""",
    ),
    "clean": (
        (),
        f"""SELECT doc_id, trim(regexp_replace(text, '{WHITESPACE}+', ' ', 'g')) AS text
            FROM documents""",
    ),
    "clean_ids": (
        ("clean", "vocab"),
        f"""SELECT c.doc_id, coalesce(i.ids, []) AS ids FROM clean c LEFT JOIN (
              SELECT w.doc_id, list(coalesce(v.token_id, 1) ORDER BY pos) AS ids
              FROM (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos
                    FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_PATTERN}') AS words
                          FROM clean)) w
              LEFT JOIN vocab v ON w.token = v.token GROUP BY w.doc_id) i USING (doc_id)""",
    ),
    "told": (
        ("lists",),
        f"""SELECT hadm_id, {PROMPT} 'admission ' || hadm_id AS prompt,
              prompt || chr(10) || chr(9) || ' '
              || array_to_string(list_transform(d, lambda c: 'ICD-9:' || c), ' ,' || chr(9))
              || ', ,no code here,' || chr(10) || array_to_string(p, ',')
              || '  ' || chr(10) AS response
            FROM lists""",
    ),
    "answers": (
        ("told",),
        f"""SELECT hadm_id, regexp_replace(replace(response, prompt, ''),
              '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g') AS answer FROM told""",
    ),
    "extracted": (
        ("answers",),
        f"""SELECT hadm_id, list_filter(list_transform(string_split(answer, ','),
              lambda c: regexp_replace(c, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')),
              lambda c: c <> '') AS codes FROM answers""",
    ),
    "described": (
        ("extracted",),
        f"""SELECT e.hadm_id, string_agg(e.code || '=' ||
              coalesce(p.p_name, '{config.NO_DESCRIPTION}'), '|' ORDER BY e.pos) AS predictions
            FROM (SELECT hadm_id, unnest(codes[1:{config.DEFAULT_MAX_CODES}]) AS code,
                    generate_subscripts(codes[1:{config.DEFAULT_MAX_CODES}], 1) AS pos
                  FROM extracted) e
            LEFT JOIN part p ON e.code = lpad(p.p_partkey::VARCHAR, 5, '0')
            GROUP BY e.hadm_id""",
    ),
    "asked": ((), f"SELECT doc_id, length({PROMPT} text) AS n FROM documents"),
    "loose": (
        ("notes", "dg"),
        """SELECT n.note_pk, n.subject_id, n.hadm_id, n.category,
             n.text, dg.codes
           FROM notes n LEFT JOIN dg ON n.subject_id = dg.subject_id AND n.hadm_id = dg.hadm_id""",
    ),
    "documents_of": (
        (),
        """SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content,
             count(*) AS page_count FROM conversations GROUP BY conv_id""",
    ),
}


def sql(select: str, *parts: str) -> str:
    """``select`` behind the CTEs it needs, in order."""
    needed: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in needed:
            for before in PARTS[name][0]:
                add(before)
            needed[name] = PARTS[name][1]

    for part in parts:
        add(part)
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in needed.items())
    return f"WITH {ctes}\n{select}" if ctes else select


def strings(prefix: str = "") -> str:
    return f"""array_to_string({prefix}d, ',') AS diagnosis_codes_str,
      array_to_string({prefix}p, ',') AS procedure_codes_str,
      array_to_string({prefix}a, ',') AS all_codes_str"""


SIZES = """len(d) AS n_diagnosis_codes, len(p) AS n_procedure_codes, len(a) AS n_all_codes"""
FLAT = f"row_id, note_pk, subject_id, hadm_id, category, text, {strings()}, gender, {SIZES}"
FLAT_IV = f"row_id, note_id, subject_id, hadm_id, note_type, text, {strings()}, gender, {SIZES}"


def prefixed(codes: str, system: str = "ICD-9", by: str = "|") -> str:
    return f"array_to_string(list_transform({codes}, lambda c: '{system}:' || c), '{by}')"


def spaced(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def tokens(length: int) -> str:
    """Ids, mask and labels, cut and padded."""
    ids = spaced(f"list_resize(ids[1:{length}], {length}, 0)")
    mask = spaced(
        f"list_transform(range(1, {length + 1}), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END)"
    )
    return f"{ids} AS input_ids, {mask} AS attention_mask, {ids} AS labels"


CODES_GROUPED = "SELECT subject_id, hadm_id, array_to_string(codes, ',') AS codes FROM "

ORACLES: dict[str, str] = {
    "processed_fact": sql(f"SELECT {FLAT} FROM fact", "fact"),
    "processed_fact_iv": sql(f"SELECT {FLAT_IV} FROM fact_iv", "fact_iv"),
    "processed_fact_cohort": sql(
        f"""SELECT {FLAT.replace('row_id,', 'row_number() OVER (ORDER BY row_id) AS row_id,')}
            FROM fact WHERE subject_id IN (SELECT subject_id FROM cohort)""",
        "fact",
        "cohort",
    ),
    "fact_row_id": sql("SELECT row_id, note_pk, subject_id, hadm_id FROM fact", "fact"),
    "discharge_notes": sql("SELECT * FROM discharge", "discharge"),
    "discharge_notes_iv": sql("SELECT * FROM discharge_iv", "discharge_iv"),
    "note_surrogate_key": sql(
        """SELECT subject_id, hadm_id, category, note_pk AS place,
             row_number() OVER (ORDER BY subject_id, note_pk) AS note_pk FROM notes""",
        "notes",
    ),
    "patient_cohort": sql("SELECT * FROM cohort", "cohort"),
    "cohort_diagnoses": sql(
        """SELECT subject_id, hadm_id, seq_num, code AS icd9_code FROM diagnoses
           WHERE subject_id IN (SELECT subject_id FROM cohort)""",
        "diagnoses",
        "cohort",
    ),
    "diagnoses_grouped": sql(CODES_GROUPED + "dg", "dg"),
    "procedures_grouped": sql(CODES_GROUPED + "pg", "pg"),
    "notes_with_diagnoses": sql(
        """SELECT n.note_pk, n.subject_id, n.hadm_id, n.category,
             array_to_string(dg.codes, ',') AS diagnosis_codes
           FROM notes n JOIN dg ON n.subject_id = dg.subject_id AND n.hadm_id = dg.hadm_id""",
        "notes",
        "dg",
    ),
    "notes_left_procedures": sql(
        """SELECT n.note_pk, n.subject_id, n.hadm_id, len(coalesce(pg.codes, [])) AS n_codes,
             array_to_string(coalesce(pg.codes, []), ',') AS procedure_codes
           FROM notes n LEFT JOIN pg ON n.subject_id = pg.subject_id AND n.hadm_id = pg.hadm_id""",
        "notes",
        "pg",
    ),
    "notes_with_gender": sql(
        """SELECT n.note_pk, n.subject_id, n.hadm_id, n.category, p.gender
           FROM notes n LEFT JOIN patients p ON n.subject_id = p.subject_id""",
        "notes",
        "patients",
    ),
    "notes_codes_by_admission": sql(
        f"""SELECT n.note_pk, n.text, {prefixed('g.codes')} AS codes, 'mimic-iii' AS source,
              n.hadm_id, n.subject_id, n.category
            FROM notes n JOIN (SELECT hadm_id, list(code ORDER BY seq_num, code) AS codes
                               FROM diagnoses GROUP BY hadm_id) g ON n.hadm_id = g.hadm_id
            WHERE n.hadm_id <> 0""",
        "notes",
        "diagnoses",
    ),
    "csv_examples": sql(
        f"""SELECT n.text, {prefixed('g.codes')} AS codes, 'mimic-iii' AS source,
              n.hadm_id, n.subject_id, n.category
            FROM notes n JOIN (SELECT hadm_id, list(code ORDER BY seq_num, code) AS codes
                               FROM diagnoses GROUP BY hadm_id) g ON n.hadm_id = g.hadm_id
            WHERE n.hadm_id <> 0""",
        "notes",
        "diagnoses",
    ),
    "all_codes": sql(
        """SELECT subject_id, hadm_id, len(a) AS n_codes, array_to_string(a, '|') AS codes
           FROM lists""",
        "lists",
    ),
    "code_strings": sql(f"SELECT row_id, {strings()} FROM fact", "fact"),
    "stage_counts": sql(
        """SELECT 'NOTEEVENTS' AS stage, count(*) AS n_rows FROM notes
           UNION ALL SELECT 'DIAGNOSES_ICD', count(*) FROM diagnoses
           UNION ALL SELECT 'PROCEDURES_ICD', count(*) FROM procedures
           UNION ALL SELECT 'PATIENTS', count(*) FROM patients
           UNION ALL SELECT 'discharge_notes', count(*) FROM discharge
           UNION ALL SELECT 'limited_patients', count(*) FROM cohort
           UNION ALL SELECT 'processed_data', count(*) FROM fact
           UNION ALL SELECT split, count(*) FROM labelled GROUP BY split
           UNION ALL SELECT 'examples', count(*) FROM examples""",
        "cohort",
        "examples",
    ),
    "split_sequential": sql("SELECT row_id, note_pk, split FROM labelled", "labelled"),
    "split_shuffled": sql(
        """SELECT row_id, note_pk, CASE WHEN place <= train_rows THEN 'train'
             WHEN place <= train_rows + val_rows THEN 'val' ELSE 'test' END AS split
           FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_id)) AS place FROM fact),
             shares""",
        "shares",
    ),
    "split_rebuild_join": sql("SELECT row_id, note_pk, gender, split FROM labelled", "labelled"),
    "all_data_union": sql(f"SELECT {FLAT}, split FROM labelled", "labelled"),
    "prepared_fact": sql(f"SELECT {FLAT}, split FROM labelled", "labelled"),
    "read_split_train": sql(
        f"SELECT {FLAT}, split FROM labelled WHERE split = 'train'", "labelled"
    ),
    "split_sizes": sql("SELECT split, count(*) AS n_rows FROM labelled GROUP BY split", "labelled"),
    "example_records": sql(
        f"""SELECT row_id, text, {prefixed('a')} AS codes, 'mimic-iii' AS source, hadm_id,
              subject_id, category FROM fact""",
        "fact",
    ),
    "example_records_iv": sql(
        f"""SELECT row_id, text, {prefixed('a', 'ICD-10')} AS codes, 'mimic-iv' AS source, hadm_id,
              subject_id, note_type FROM fact_iv""",
        "fact_iv",
    ),
    "prefixed_codes": sql(f"SELECT row_id, {prefixed('a')} AS codes FROM fact", "fact"),
    "training_examples": sql(
        """SELECT note_pk, text, array_to_string(codes, '|') AS codes FROM loose
           WHERE text <> '' AND codes IS NOT NULL""",
        "loose",
    ),
    "examples_required_fields": sql(
        """SELECT note_pk, text, array_to_string(codes, '|') AS codes,
             CASE WHEN category = 'Discharge summary' THEN hadm_id END AS hadm_id,
             CASE WHEN category = 'Discharge summary' THEN category END AS category
           FROM loose WHERE text IS NOT NULL AND codes IS NOT NULL""",
        "loose",
    ),
    "clean_text": sql("SELECT doc_id, text FROM clean", "clean"),
    "prompts": sql(f"SELECT doc_id, {PROMPT} text AS prompt FROM documents"),
    "completions": sql(
        "SELECT subject_id, hadm_id, array_to_string(codes, ', ') AS completion FROM dg", "dg"
    ),
    "prompt_pairs": sql("SELECT row_id, prompt, completion FROM examples", "examples"),
    "causal_text": sql("SELECT row_id, prompt || completion AS text FROM examples", "examples"),
    "vocabulary_topk": sql("SELECT token, n, token_id FROM vocab", "vocab"),
    "causal_tokens": sql(f"SELECT split, row_id, {tokens(LENGTH)} FROM causal_ids", "causal_ids"),
    "token_json_roundtrip": sql(
        f"""SELECT split, row_id, replace(to_json(padded)::VARCHAR, ' ', '') AS json,
              len(padded) AS n_ids, len(ids) AS n_used, {spaced('padded')} AS labels
            FROM (SELECT *, list_resize(ids, {LENGTH}, 0) AS padded FROM causal_ids)""",
        "causal_ids",
    ),
    "token_table_read": sql(f"SELECT id, {tokens(LENGTH)} FROM val_ids", "val_ids"),
    "cleaned_tokens": sql(
        f"""SELECT doc_id, {spaced('ids')} AS input_ids,
              {spaced('list_transform(ids, lambda i: 1)')} AS mask FROM clean_ids""",
        "clean_ids",
    ),
    "cleaned_tokens_padded": sql(
        f"""SELECT doc_id, input_ids, attention_mask AS mask
            FROM (SELECT doc_id, {tokens(LENGTH)} FROM clean_ids)""",
        "clean_ids",
    ),
    "example_ids": sql(
        """SELECT split, row_id, note_pk,
             row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS id FROM labelled""",
        "labelled",
    ),
    "strip_prompt_echo": sql("SELECT hadm_id, answer FROM answers", "answers"),
    "extract_codes": sql(
        "SELECT hadm_id, array_to_string(codes, '|') AS codes FROM extracted", "extracted"
    ),
    "parse_codes": sql(
        """SELECT hadm_id, array_to_string(list_filter(codes,
             lambda c: contains(c, ':') OR contains(c, '-')), '|') AS codes FROM extracted""",
        "extracted",
    ),
    "cap_codes": sql(
        "SELECT hadm_id, array_to_string(codes[1:3], '|') AS codes FROM extracted", "extracted"
    ),
    "describe_codes": sql("SELECT hadm_id, predictions FROM described", "described"),
    "prediction_json_sink": sql("SELECT hadm_id, predictions FROM described", "described"),
    "response_envelope": sql(
        f"""SELECT hadm_id, sha256(hadm_id::VARCHAR) AS request_id, '{TIMESTAMP}' AS timestamp,
              predictions, '{MODEL_VERSION}' AS version FROM described""",
        "described",
    ),
    "batch_predict_stub": sql(
        f"""SELECT doc_id,
              CASE WHEN n % 10 = 0 THEN '' ELSE 'ICD-9:' || n || '|X-' || n % 7 || '|plain' END
                AS codes,
              '{MODEL_VERSION}' AS model_version,
              CASE WHEN n % 10 = 0 THEN 'cannot answer length ' || n END AS error
            FROM asked""",
        "asked",
    ),
    "error_envelope": sql(
        f"""SELECT doc_id, 'PREDICTION_ERROR' AS code, 'Error predicting codes' AS message,
              'cannot answer length ' || n AS reason,
              'Please try again with different text' AS suggestion,
              sha256(doc_id::VARCHAR) AS request_id, '{TIMESTAMP}' AS timestamp
            FROM asked WHERE n % 10 = 0""",
        "asked",
    ),
    "document_pages_concat": sql("SELECT * FROM documents_of", "documents_of"),
    "empty_documents": sql(
        f"""SELECT '{config.EMPTY_DOCUMENT}' AS error, '' AS codes,
              'conversation-' || (-conv_id - 1) AS filename, count(*) AS page_count
            FROM conversations GROUP BY conv_id
            UNION ALL
            SELECT '{config.EMPTY_DOCUMENT}', '', 'conversation-' || conv_id, count(*)
            FROM conversations GROUP BY conv_id HAVING sum(length(coalesce(text, ''))) = 0"""
    ),
    "score_documents": sql(
        f"""SELECT conv_id, 'conversation-' || conv_id AS filename, page_count,
              '{MODEL_VERSION}' AS model_version, NULL::VARCHAR AS error,
              'ICD-10:I10={DESCRIPTIONS["ICD-10:I10"]}|ICD-9:' || length({PROMPT} content)
              || '=Description not available'
              || '|ICD-10:E11.9={DESCRIPTIONS["ICD-10:E11.9"]}|'
              || array_to_string(list_transform(range(7),
                   lambda i: 'N-' || i || '=Description not available'), '|') AS predictions
            FROM documents_of""",
        "documents_of",
    ),
    "score_documents_resumed": sql(
        f"""SELECT conv_id, page_count, '{MODEL_VERSION}' AS model_version, NULL::VARCHAR AS error,
              'ICD-10:I10={DESCRIPTIONS["ICD-10:I10"]}|ICD-9:' || length({PROMPT} content)
              || '=Description not available'
              || '|ICD-10:E11.9={DESCRIPTIONS["ICD-10:E11.9"]}|'
              || array_to_string(list_transform(range(7),
                   lambda i: 'N-' || i || '=Description not available'), '|') AS predictions
            FROM documents_of""",
        "documents_of",
    ),
    "csv_ingest_notes": sql("SELECT * FROM notes", "notes"),
    "csv_ingest_codes_iv": sql(
        "SELECT subject_id, hadm_id, seq_num, code AS icd_code FROM diagnoses", "diagnoses"
    ),
    "dataset_json_load": "SELECT doc_id, text, lang FROM documents",
    "dataset_csv_load": "SELECT doc_id, text, lang FROM documents",
    "prepared_without_note_keys": sql(
        f"""SELECT {FLAT.replace('note_pk', 'place AS note_pk')}, split
            FROM labelled JOIN (SELECT note_pk, row_number() OVER (ORDER BY note_pk) AS place
                                FROM notes) USING (note_pk)""",
        "labelled",
    ),
    "csv_ingest_float_ids": sql(
        """SELECT subject_id || CASE WHEN hadm_id % 10 = 0 THEN '?' ELSE '' END AS subject_id,
             hadm_id, seq_num, code AS icd9_code, hadm_id % 10 = 0 AS aside FROM diagnoses""",
        "diagnoses",
    ),
    "ingest_skips_what_is_there": sql(
        "SELECT subject_id, gender, '?' AS replaced FROM patients", "patients"
    ),
    "documents_from_files": sql(
        """SELECT doc_id, CASE WHEN n % 10 <> 0
               THEN 'ICD-9:' || n || '|X-' || n % 7 || '|plain' END AS codes,
             CASE WHEN n % 10 = 0 THEN 'PDF_PROCESSING_ERROR' END AS code,
             CASE WHEN n % 10 = 0 THEN 'cannot answer length ' || n END AS reason
           FROM asked
           UNION ALL
           SELECT -1 - doc_id, NULL, 'PDF_PROCESSING_ERROR', CASE doc_id % 100
             WHEN 7 THEN 'Could not process PDF: cannot read this file'
             ELSE 'No text could be extracted from the PDF' END
           FROM documents WHERE doc_id % 100 IN (7, 8)""",
        "asked",
    ),
}
