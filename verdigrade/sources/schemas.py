"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(ddl: str) -> T.StructType:
    """A schema from name:type pairs, without a session. Types: s l i d b t, [x] arrays and {x} maps from strings."""
    base = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "c": T.DecimalType(12, 6)}

    def kind(x: str) -> T.DataType:
        if x[0] == "[":
            return T.ArrayType(kind(x[1:-1]))
        if x[0] == "{":
            return T.MapType(T.StringType(), kind(x[1:-1]))
        return base[x]

    return T.StructType([T.StructField(n, kind(k)) for n, k in (p.split(":") for p in ddl.split())])


CASE = _s("id:s task_type:s inputs:{s} reference_answer:s references:[s] expected_label:s expected_json:s qrels:{i} slices:{s} must_contain:[s] must_not_contain:[s] canary:s weight:d provenance:{s}")
GENERATION = _s("id:l run_id:s case_id:s repeat_idx:i output:s tool_calls:s finish_reason:s outcome:s prompt_tokens:i completion_tokens:i cost_usd:c ttft_ms:d total_ms:d queue_wait_ms:d attempts:i attempt_log:s cached:b raw_response:s trace_id:s created_at:t")
SCORE = _s("id:l generation_id:l metric_name:s metric_version:s metric_config_sha256:s value:d passed:b detail:s scored_at:t")
AGGREGATE = _s("run_id:s metric_name:s metric_version:s metric_config_sha256:s slice_key:s n:l value:d ci_low:d ci_high:d stddev:d method:s")
DATASET = _s("id:l name:s version:s content_sha256:s split:s manifest:s created_at:t")
PROMPT_TEMPLATE = _s("id:l name:s version:s body:s content_sha256:s")
MODEL_VERSION = _s("id:l provider:s model:s resolved_version:s quantization:s params_b:d context_window:i capabilities:s")
RUN = _s("id:s dataset_id:l prompt_template_id:l model_version_id:l decode_params:s config_sha256:s harness_version:s git_sha:s repeats:i status:s tenant_id:s started_at:t finished_at:t baseline_run_id:s")
RESPONSE_CACHE = _s("cache_key:s response:s created_at:t")
CANDIDATE = _s("case_id:s generation_id:s candidate_text:s prompt:s reference:s")
PAIR = _s("case_id:s model_a:s model_b:s candidate_a:s candidate_b:s prompt:s reference:s")
LABEL = _s("schema_version:s rubric_name:s rubric_version:s case_id:s label_shape:s label_value:s split:s label_set_id:s")
MOCK_RESPONSE = _s("generation_id:s case_id:s swap:i score:d preference:s reasoning:s")
EVIDENCE = _s("case_id:s answer_text:s claims:[s] context_ids:[s] context_texts:[s] citations:[s] qrels:{i}")
NLI = _s("case_id:s claim_index:i doc_id:s label:s")

# The domains of enumerated columns.
TASK_TYPES = ("generation", "classification", "extraction", "summarization", "qa_short", "retrieval", "rag", "tool_use", "agent_trajectory", "safety", "pairwise")
OUTCOMES = ("passed", "failed_score", "refused", "truncated", "schema_invalid", "empty_output", "content_filtered", "model_error", "harness_timeout", "harness_error", "skipped")
FINISH_REASONS = ("stop", "length", "tool_calls", "content_filter", "error")
