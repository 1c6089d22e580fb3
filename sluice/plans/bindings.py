"""Triage tables derived from the given tables.

Each binding is one SELECT in the SQL that Spark and DuckDB share, with ``{name}`` for a given table or another
binding. Spark resolves the names to DataFrames; the checking SQL gets the same text as CTEs. Only plain
arithmetic, ``concat`` and ``CASE``: every derived row is a function of its source row.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice import schemas
from sluice.operators.skew import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _pick(value: str, labels) -> str:
    cases = " ".join(f"WHEN {place} THEN '{label}'" for place, label in enumerate(labels))
    return f"CASE {value} {cases} END"


ARRIVAL = ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")

BINDINGS: dict[str, str] = {
    "messages": """
        SELECT concat(conv_id, '-', turn) AS id, concat('area-', conv_id % 7) AS source_area, text AS message
        FROM {conversations} WHERE role = 'user'""",
    "tickets": """
        SELECT concat('t-', event_id) AS id, user_id, ts,
               CASE event_type
                 WHEN 'error' THEN concat('El checkout muestra error 500 y cobra dos veces a clientes, contacto: 55 1234 ', user_id + 1000)
                 WHEN 'click' THEN concat('O relatório de vendas da conta ', user_id, ' não abre para o cliente u', user_id, '@loja.com.br')
                 WHEN 'view' THEN concat('Necesito acceso al servidor para la cuenta ', user_id)
                 WHEN 'signup' THEN concat('Queremos automatizar la planilla manual del pedido 55 1234 ', user_id + 1000, ' para el equipo')
                 ELSE concat('Duda: como explicar a política do pedido ', event_id, '?')
               END AS message
        FROM {events}""",
    "identifiers": """
        SELECT o_orderkey AS id,
               CASE o_orderkey % 12
                 WHEN 0 THEN concat('CNPJ: ', lpad(concat('', o_orderkey), 14, '0'), ' fim')
                 WHEN 1 THEN concat('valor ', lpad(concat('', o_orderkey), 14, '7'), ' fim')
                 WHEN 2 THEN concat('empresa 12.345.678/', lpad(concat('', o_custkey), 4, '0'), '-95, ok')
                 WHEN 3 THEN concat('RFC abcd', substr(concat('', o_orderdate), 3, 2), substr(concat('', o_orderdate), 6, 2), substr(concat('', o_orderdate), 9, 2), '1a2 fim')
                 WHEN 4 THEN concat('llamar +52 55 1234 ', lpad(concat('', o_custkey), 4, '0'), ', gracias')
                 WHEN 5 THEN concat('ligar +55 (11) 91234-', lpad(concat('', o_custkey), 4, '0'), ', obrigado')
                 WHEN 6 THEN concat('pedido 55 1234 ', lpad(concat('', o_custkey), 4, '0'), ' listo')
                 WHEN 7 THEN concat('oficina 55 1234 ', lpad(concat('', o_custkey), 4, '0'), ' hoy')
                 WHEN 8 THEN concat('celular: ', lpad(concat('', o_orderkey), 10, '5'), ' hoy')
                 WHEN 9 THEN concat('folio ', lpad(concat('', o_orderkey), 11, '5'), ' hoy')
                 WHEN 10 THEN concat('correo ana.', o_orderkey, '@mail.example.com hoy')
                 ELSE concat('sin datos ', o_orderkey)
               END AS text
        FROM {orders}""",
    "texts": """
        SELECT concat('d-', doc_id) AS id, text FROM {documents}
        UNION ALL SELECT concat('o-', id) AS id, text FROM {identifiers}
        UNION ALL SELECT id, message AS text FROM {tickets}""",
    "spaced_numbers": """
        SELECT id, kind, concat('Aviso ', word, repeat(' ', gap), CASE WHEN id % 5 = 0 THEN ':' WHEN id % 5 = 1 THEN '# ' ELSE ' ' END) AS before,
               CASE kind WHEN 'cnpj' THEN concat('9', lpad(concat('', id), 12, '0'), '9') WHEN 'bare' THEN lpad(concat('', id), 10, '5') ELSE concat('55 1234 ', lpad(concat('', id % 10000), 4, '0')) END AS number
        FROM (SELECT o_orderkey AS id, o_custkey % 26 AS gap,
                     CASE o_orderkey % 3 WHEN 0 THEN 'cnpj' WHEN 1 THEN 'bare' ELSE 'local' END AS kind,
                     CASE o_orderkey % 9 WHEN 0 THEN 'CNPJ' WHEN 3 THEN 'miCNPJ' WHEN 6 THEN 'empresa' WHEN 1 THEN 'celular' WHEN 4 THEN 'micelular' WHEN 7 THEN 'mitel'
                       WHEN 2 THEN 'pedido' WHEN 5 THEN 'mipedido' ELSE 'id' END AS word
              FROM {orders}) AS s_""",
    "bare_numbers": """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 5 = 0 THEN lpad('', 14, concat('', o_custkey % 10))
                    ELSE lpad(concat('', o_orderkey * 7919 + o_custkey), 14, concat('', o_custkey)) END AS digits
        FROM {orders}""",
    "submissions": """
        SELECT concat('r-', l_orderkey) AS id, concat(l_returnflag, l_linestatus) AS raw_message,
               l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax
        FROM {lineitem}""",
    "terminal_events": """
        SELECT concat('r-', l_orderkey) AS id,
               CASE l_returnflag WHEN 'A' THEN 'failed' ELSE 'completed' END AS target,
               CASE l_returnflag WHEN 'A' THEN 'timeout' END AS failure_code,
               l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax
        FROM {lineitem}""",
    "requests": f"""
        SELECT concat('r-', o_orderkey) AS id, o_orderkey AS key_number, o_orderpriority AS priority_text,
               concat(o_orderpriority, ' ', o_orderkey) AS raw_message,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS state,
               {_pick('o_orderkey % 6', V.CATEGORIES)} AS categoria,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'alta'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'media' ELSE 'baja' END AS prioridad,
               {_pick('o_custkey % 6', V.AREAS)} AS area_sugerida,
               {_pick('o_orderkey % 2', V.LANGUAGES)} AS idioma,
               concat('Pedido del cliente número ', o_custkey) AS resumen,
               o_totalprice > 200000 AS requiere_info,
               CASE WHEN o_totalprice > 200000 THEN concat('¿Qué falta en ', o_orderkey, '?') END AS pregunta_seguimiento,
               CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confianza,
               CASE WHEN o_orderstatus = 'P' THEN 'timeout' END AS failure_code,
               o_totalprice, o_orderdate AS created_at
        FROM {{orders}}""",
    "reference_labels": """
        SELECT id, categoria AS ref_categoria, prioridad AS ref_prioridad, area_sugerida AS ref_area_sugerida,
               idioma AS ref_idioma, requiere_info AS ref_requiere_info
        FROM {requests}""",
    "outcome_states": """
        SELECT requests_.*,
               CASE WHEN state = 'failed' AND priority_text = '1-URGENT' THEN 'failed'
                    WHEN state = 'failed' AND priority_text = '5-LOW' THEN 'pending'
                    WHEN state = 'failed' AND priority_text = '2-HIGH' THEN 'interrupted_unknown'
                    ELSE 'succeeded' END AS outcome_state
        FROM {requests} AS requests_
        WHERE NOT (state = 'processing' AND priority_text = '4-NOT SPECIFIED')""",
    "outcomes_v1": f"""
        SELECT id, outcome_state AS state,
               CASE WHEN outcome_state = 'failed' AND key_number % 4 > 0
                    THEN {_pick('key_number % 4', ('timeout', 'timeout', 'rate_limit', 'refusal'))} END AS failure_category,
               CASE WHEN outcome_state = 'succeeded' THEN CASE WHEN key_number % 7 = 0 THEN 'otro' ELSE categoria END END AS categoria,
               CASE WHEN outcome_state = 'succeeded' THEN CASE WHEN key_number % 5 = 0 THEN 'media' ELSE prioridad END END AS prioridad,
               CASE WHEN outcome_state = 'succeeded' THEN CASE WHEN key_number % 11 = 0 THEN 'data' ELSE area_sugerida END END AS area_sugerida,
               CASE WHEN outcome_state = 'succeeded' THEN idioma END AS idioma,
               CASE WHEN outcome_state = 'succeeded' THEN CASE WHEN key_number % 3 = 0 THEN NOT requiere_info ELSE requiere_info END END AS requiere_info,
               CASE WHEN outcome_state = 'succeeded' THEN confianza END AS confianza
        FROM {{outcome_states}}""",
    "outcomes_v2": """
        SELECT id, outcome_state AS state,
               CASE WHEN outcome_state = 'failed' THEN 'connection' END AS failure_category,
               CASE WHEN outcome_state = 'succeeded' THEN CASE WHEN key_number % 13 = 0 THEN 'bug' ELSE categoria END END AS categoria,
               CASE WHEN outcome_state = 'succeeded' THEN CASE WHEN key_number % 4 = 0 THEN 'alta' ELSE prioridad END END AS prioridad,
               CASE WHEN outcome_state = 'succeeded' THEN CASE WHEN key_number % 11 = 0 THEN 'devops' ELSE area_sugerida END END AS area_sugerida,
               CASE WHEN outcome_state = 'succeeded' THEN idioma END AS idioma,
               CASE WHEN outcome_state = 'succeeded' THEN CASE WHEN key_number % 9 = 0 THEN NOT requiere_info ELSE requiere_info END END AS requiere_info,
               CASE WHEN outcome_state = 'succeeded' THEN confianza END AS confianza
        FROM {outcome_states}""",
    "run_results": """
        SELECT concat('run-', key_number % 97) AS run_id, key_number % 97 AS run_number, id, key_number,
               outcome_state AS state,
               CASE WHEN outcome_state = 'succeeded' THEN CASE WHEN key_number % 97 > 60 AND key_number % 2 = 0 THEN 'v2' ELSE 'v1' END END AS version_prompt,
               CASE WHEN outcome_state = 'succeeded' THEN CASE WHEN key_number % 97 > 80 AND key_number % 3 = 0 THEN 'model-b' ELSE 'model-a' END END AS model
        FROM {outcome_states}""",
    "trial_results": """
        SELECT concat('trial-', key_number % 40) AS run_id, key_number % 40 AS run_number, id, key_number,
               CASE WHEN key_number % 40 IN (3, 13, 23) AND key_number % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS state,
               CASE WHEN key_number % 40 = 20 AND key_number % 80 = 20 THEN 'v9' ELSE concat('v', key_number % 40 % 4 + 1) END AS version_prompt,
               CASE WHEN key_number % 40 = 21 AND key_number % 80 = 21 THEN 'model-c' WHEN key_number % 40 = 22 THEN 'model-b' ELSE 'model-a' END AS model
        FROM {requests} WHERE NOT (key_number % 40 IN (9, 19) AND key_number % 3 = 0)""",
    "trial_headers": """
        SELECT DISTINCT run_id, run_number, run_number * 10 AS created_at, concat('v', run_number % 4 + 1) AS prompt_version,
               CASE WHEN run_number % 4 = 3 THEN 'p-2' ELSE concat('p-', run_number % 4) END AS prompt_sha256,
               CASE WHEN run_number < 30 THEN 'm-1' ELSE 'm-2' END AS messages_sha256, 'refs' AS references_sha256,
               CASE WHEN run_number % 5 = 4 THEN 'x-2' ELSE 'x-1' END AS execution
        FROM {trial_results}""",
    "event_numbers": """
        SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
               event_id % 10 AS m
        FROM {events}""",
    "attempt_numbers": """
        SELECT event_id AS line, user_id, event_type, value, k, m, concat('run-', user_id) AS run_id,
               CASE WHEN m = 9 AND event_type = 'view' THEN concat('x-', event_id) ELSE concat('m-', user_id, '-', m) END AS message_id,
               CASE WHEN k = 13 THEN 0 WHEN k = 14 THEN NULL ELSE k % 4 + 1 END AS attempt
        FROM {event_numbers}""",
    "attempts": """
        SELECT line, run_id, message_id, attempt, 'model-a' AS model,
               CASE WHEN k = 50 THEN 'v0' ELSE 'v1' END AS prompt_version,
               value AS latency_ms,
               CASE WHEN k = 91 THEN NULL WHEN attempt = 4 AND m < 3 THEN TRUE WHEN m < 2 THEN FALSE ELSE event_type = 'purchase' END AS success,
               CASE event_type WHEN 'click' THEN 'timeout' WHEN 'error' THEN 'server_error' WHEN 'signup' THEN 'rate_limit' WHEN 'view' THEN 'refusal' END AS error_type,
               CASE WHEN k % 9 = 0 THEN NULL WHEN attempt = 4 THEN 100 + user_id ELSE 100 + k END AS input_tokens,
               CASE WHEN k % 9 = 0 THEN NULL WHEN attempt = 4 THEN user_id % 20 ELSE k % 20 END AS output_tokens,
               CASE WHEN k % 9 = 0 THEN NULL WHEN attempt = 4 THEN user_id % 5 ELSE k % 5 END AS cached_input_tokens,
               CASE WHEN k % 9 = 0 OR k = 77 THEN NULL WHEN attempt = 4 THEN CAST(user_id % 10 AS DOUBLE) / 1000 ELSE CAST(k AS DOUBLE) / 1000 END AS estimated_cost_usd
        FROM {attempt_numbers}""",
    "run_items": f"""
        SELECT DISTINCT concat('run-', user_id) AS run_id, concat('m-', user_id, '-', m) AS id, user_id,
               CASE WHEN m < 5 THEN 'succeeded' ELSE {_pick('m', ('', '', '', '', '', 'failed', 'pending', 'running', 'interrupted_unknown', 'succeeded'))} END AS state,
               'v1' AS prompt_version, 4 AS max_attempts,
               CASE WHEN m < 5 OR m = 9 THEN 'model-a' END AS meta_model,
               CASE WHEN m < 5 OR m = 9 THEN 4 END AS meta_attempt,
               CASE WHEN m < 5 OR m = 9 THEN 100 + user_id END AS meta_input_tokens,
               CASE WHEN m < 5 OR m = 9 THEN user_id % 20 END AS meta_output_tokens,
               CASE WHEN m < 5 OR m = 9 THEN user_id % 5 END AS meta_cached_input_tokens,
               CASE WHEN m < 5 OR m = 9 THEN CAST(user_id % 10 AS DOUBLE) / 1000 END AS meta_estimated_cost_usd
        FROM {{event_numbers}}""",
    "corrections": f"""
        SELECT concat('r-', user_id) AS id, ts, event_id AS seq,
               k % 2 = 1 AS has_categoria,
               {_pick('k % 7', (*V.CATEGORIES, 'urgente'))} AS categoria,
               k % 4 >= 2 AS has_prioridad,
               {_pick('k % 3', V.PRIORITIES)} AS prioridad,
               k % 8 >= 4 AS has_area_sugerida,
               {_pick('user_id % 6', V.AREAS)} AS area_sugerida,
               event_type = 'view' AS has_idioma,
               {_pick('k % 2', V.LANGUAGES)} AS idioma,
               event_type = 'click' AS has_resumen,
               CASE WHEN k < 3 THEN '' ELSE concat('Cambio del pedido ', k) END AS resumen,
               event_type IN ('purchase', 'signup') AS has_requiere_info,
               value < 50 AS requiere_info,
               event_type IN ('purchase', 'error') AS has_pregunta_seguimiento,
               CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 60 THEN concat('¿Cuál es el dato ', k, '?') END
                    WHEN value < 20 THEN '¿Cuál?' WHEN value < 25 THEN ' ' END AS pregunta_seguimiento
        FROM {{event_numbers}}""",
    "judged_corrections": """
        SELECT CASE WHEN seq % 11 = 0 THEN concat('none-', seq) ELSE id END AS id, ts, seq, has_categoria, categoria, has_prioridad, prioridad, has_area_sugerida, area_sugerida, has_idioma, idioma,
               has_resumen, CASE WHEN seq % 6 = 0 THEN 'The thing was then there with others' WHEN seq % 6 = 1 THEN NULL ELSE 'Cambio del pedido revisado para el cliente' END AS resumen,
               has_requiere_info, requiere_info, has_pregunta_seguimiento, pregunta_seguimiento
        FROM {corrections}""",
    "candidates": """
        SELECT id AS row_id, key_number,
               CASE WHEN key_number % 41 = 0 THEN concat(' ', chr(9)) WHEN key_number % 43 = 0 THEN '' ELSE id END AS id,
               CASE WHEN key_number % 19 = 0 THEN 'queja' WHEN key_number % 53 = 0 THEN NULL ELSE categoria END AS categoria,
               CASE WHEN key_number % 23 = 0 THEN 'urgente' ELSE prioridad END AS prioridad,
               CASE WHEN key_number % 29 = 0 THEN 'ventas' ELSE area_sugerida END AS area_sugerida,
               CASE WHEN key_number % 31 = 0 THEN 'en' ELSE idioma END AS idioma,
               CASE WHEN key_number % 14 = 0 THEN '' WHEN key_number % 14 = 1 THEN concat(repeat('palabra ', 20), 'final')
                    WHEN key_number % 14 = 2 THEN concat(' ', repeat(concat('palabra', chr(9), ' ', chr(10)), 20), ' ')
                    WHEN key_number % 14 = 3 THEN concat(' ', chr(10)) WHEN key_number % 59 = 0 THEN NULL ELSE resumen END AS resumen,
               CASE WHEN key_number % 61 = 0 THEN NULL ELSE requiere_info END AS requiere_info,
               CASE WHEN key_number % 9 = 0 THEN NULL WHEN key_number % 9 = 1 THEN '' WHEN key_number % 9 = 2 THEN concat(' ', chr(10))
                    WHEN key_number % 9 = 3 THEN '¿Qué pasó?' ELSE pregunta_seguimiento END AS pregunta_seguimiento,
               CASE WHEN key_number % 10 = 0 THEN -0.01 WHEN key_number % 10 = 1 THEN 1.01 WHEN key_number % 10 = 2 THEN CAST('NaN' AS DOUBLE)
                    WHEN key_number % 10 = 3 THEN CAST('Infinity' AS DOUBLE) WHEN key_number % 10 = 4 THEN 0 WHEN key_number % 10 = 5 THEN 1
                    WHEN key_number % 67 = 0 THEN NULL ELSE confianza END AS confianza,
               CASE WHEN key_number % 37 = 0 THEN '  ' ELSE 'v1' END AS version_prompt
        FROM {requests}""",
    "answers": """
        SELECT id, key_number,
               CASE key_number % 14
                 WHEN 0 THEN concat('{"categoria":"', categoria, '","prioridad":"', prioridad, '","area_sugerida":"', area_sugerida, '","idioma":"', idioma, '","resumen":"', resumen, '","requiere_info":false,"confianza":0.5}')
                 WHEN 1 THEN concat('{"categoria":"', categoria, '","prioridad":"', prioridad, '","area_sugerida":"', area_sugerida, '","idioma":"', idioma, '","resumen":"', resumen, '","requiere_info":false,"pregunta_seguimiento":null,"confianza":0.5,"justification":"x"}')
                 WHEN 2 THEN concat('{"categoria":"', categoria, '","prioridad":"', prioridad, '","area_sugerida":"', area_sugerida, '","idioma":"', idioma, '","resumen":"', resumen, '","requiere_info":"true","pregunta_seguimiento":null,"confianza":0.5}')
                 WHEN 3 THEN concat('{"categoria":"', categoria, '","prioridad":"', prioridad, '","area_sugerida":"', area_sugerida, '","idioma":"', idioma, '","resumen":"', resumen, '","requiere_info":1,"pregunta_seguimiento":null,"confianza":"0.85"}')
                 WHEN 4 THEN concat('{"categoria":', key_number, ',"prioridad":[],"area_sugerida":{},"idioma":true,"resumen":"', resumen, '","requiere_info":false,"pregunta_seguimiento":7,"confianza":true}')
                 WHEN 5 THEN concat('[', key_number, ']')
                 WHEN 6 THEN concat('no es json ', key_number)
                 WHEN 7 THEN concat('{"categoria":"', categoria, '"} resto')
                 WHEN 8 THEN '{}'
                 WHEN 9 THEN concat('{"categoria":"', categoria, '","prioridad":"', prioridad, '","area_sugerida":"', area_sugerida, '","idioma":"', idioma, '","resumen":"', resumen, '","requiere_info":false,"pregunta_seguimiento":null,"confianza":1}')
                 ELSE concat('{"categoria":"', categoria, '","prioridad":"', prioridad, '","area_sugerida":"', area_sugerida, '","idioma":"', idioma, '","resumen":"', resumen, '","requiere_info":true,"pregunta_seguimiento":"¿', key_number, '?","confianza":0.75}')
               END AS answer
        FROM {requests}""",
    "payloads": """
        SELECT o_orderkey AS row_id,
               CASE o_orderkey % 8
                 WHEN 0 THEN concat('{"id":"', o_orderkey, '","mensaje":"', o_orderpriority, '"}')
                 WHEN 1 THEN concat('{"id":" ","mensaje":"', o_orderpriority, '"}')
                 WHEN 2 THEN concat('{"id":"', o_orderkey, '","mensaje":""}')
                 WHEN 3 THEN concat('{"id":', o_orderkey, ',"mensaje":"', o_orderpriority, '"}')
                 WHEN 4 THEN concat('{"id":"', o_orderkey, '","mensaje":"x","extra":1}')
                 WHEN 5 THEN concat('{"mensaje":"', o_orderpriority, '"}')
                 WHEN 6 THEN concat('"', o_orderkey, '"')
                 ELSE concat('{"id":"', o_orderkey, '","mensaje":null}')
               END AS payload
        FROM {orders}""",
    "message_lines": """
        SELECT o_orderkey AS number,
               CASE o_orderkey % 9
                 WHEN 0 THEN concat('{"id":', o_orderkey, ',"source_area":"a","message":"m","extra":1}')
                 WHEN 1 THEN concat('{"id":"k', o_orderkey, '","source_area":"a"}')
                 WHEN 2 THEN concat('{"id":"k', o_orderkey, '","source_area":" ","message":""}')
                 WHEN 3 THEN concat('{"id":"k', o_orderkey, '","source_area":"a","message":"m"} resto')
                 ELSE concat('{"id":"k', o_orderkey, '","source_area":"area } ', o_custkey, '","message":"', o_orderpriority, '"}')
               END AS line
        FROM {orders}""",
    "change_sets": """
        SELECT concat('r-', user_id) AS id, ts, event_id AS seq,
               CASE k % 9
                 WHEN 0 THEN '{}'
                 WHEN 1 THEN concat('{"categoria":"datos","confianza":', k, '}')
                 WHEN 2 THEN '{"categoria":"datos"}'
                 WHEN 3 THEN '{"prioridad":"urgente"}'
                 WHEN 4 THEN '{"requiere_info":"no"}'
                 WHEN 5 THEN '{"requiere_info":false,"pregunta_seguimiento":null}'
                 WHEN 6 THEN concat('{"requiere_info":true,"pregunta_seguimiento":"¿Dato ', k, '?"}')
                 WHEN 7 THEN concat('{"resumen":"Pedido ', k, ' revisado"}')
                 ELSE '{"pregunta_seguimiento":null}'
               END AS changes
        FROM {event_numbers}""",
    "call_metadata": """
        SELECT event_id AS id, k,
               CASE WHEN k % 7 = 0 THEN NULL WHEN k % 29 = 1 THEN -k ELSE k END AS input_tokens,
               CASE WHEN k % 5 = 0 THEN NULL ELSE k * 2 END AS output_tokens,
               CASE WHEN k % 3 = 0 THEN NULL WHEN k % 11 = 0 THEN k + 1 ELSE k % 4 END AS cached_input_tokens,
               CASE WHEN k = 8 THEN 0 WHEN k = 9 THEN NULL ELSE k % 3 + 1 END AS attempt,
               value - 1 AS latency_ms, CASE WHEN k > 90 THEN -0.5 WHEN k > 50 THEN 0.25 END AS estimated_cost_usd
        FROM {event_numbers}""",
    "request_rows": """
        SELECT id, key_number,
               CASE WHEN key_number % 17 = 0 THEN 'abandoned' ELSE state END AS state,
               CASE WHEN state = 'completed' OR key_number % 19 = 0 THEN categoria END AS ai_classification,
               CASE WHEN state = 'completed' AND key_number % 23 <> 0 THEN 'm' END AS provider_metadata,
               CASE WHEN key_number % 29 = 0 THEN 'c' END AS human_correction,
               CASE WHEN key_number % 31 = 0 THEN 'queja' WHEN state = 'completed' THEN categoria END AS effective_category,
               CASE WHEN state = 'completed' AND key_number % 37 <> 0 THEN prioridad END AS effective_priority,
               CASE WHEN state = 'completed' THEN area_sugerida END AS effective_area,
               CASE WHEN key_number % 41 = 0 THEN 'timeout' WHEN key_number % 43 = 0 THEN NULL ELSE failure_code END AS failure_code,
               CASE WHEN state = 'completed' THEN created_at END AS classified_at,
               CASE WHEN key_number % 58 = 0 THEN created_at END AS corrected_at
        FROM {requests}""",
    "run_checkpoints": """
        SELECT run_id, run_number, id, key_number,
               CASE WHEN key_number = 4001 THEN 'lost' ELSE state END AS state,
               CASE WHEN state = 'succeeded' THEN CASE WHEN key_number % 1009 = 0 THEN 'otro-id' ELSE id END END AS classification_id,
               CASE WHEN state = 'succeeded' THEN CASE WHEN key_number % 2003 = 0 THEN 'v9' ELSE 'v1' END END AS metadata_version,
               'v1' AS prompt_version
        FROM {run_results}""",
    "run_errors": """
        SELECT concat('run-', key_number % 97) AS run_id, key_number AS position,
               CASE WHEN state = 'failed' AND o_totalprice > 490000 THEN 'authentication'
                    WHEN state = 'failed' AND o_totalprice > 480000 THEN 'configuration'
                    WHEN state = 'failed' THEN 'timeout' END AS error_type
        FROM {requests}""",
    "price_rows": """
        SELECT p_partkey AS id, p_brand AS model,
               CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size = 50 THEN -1 ELSE p_size END AS input_per_million,
               CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS output_per_million,
               CASE WHEN p_size % 3 = 0 THEN p_size END AS cached_input_per_million
        FROM {part}""",
    "pricing": """
        SELECT concat('brand-', p_brand) AS model,
               CAST(MIN(p_size) AS DECIMAL(12, 6)) / 10 AS input_per_million,
               CAST(MAX(p_size) AS DECIMAL(12, 6)) / 10 AS output_per_million,
               CASE WHEN MIN(p_brand) <> 'Brand#11' THEN CAST(MIN(p_size) AS DECIMAL(12, 6)) / 100 END AS cached_input_per_million
        FROM {part} GROUP BY p_brand""",
    "calls": """
        SELECT l_orderkey AS call_id, l_linenumber, concat('brand-', CASE WHEN l_tax = 0 THEN 'none' ELSE p_brand END) AS model,
               CASE WHEN l_discount = 0.1 THEN NULL ELSE l_partkey END AS input_tokens,
               CAST(l_quantity AS BIGINT) AS output_tokens,
               CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS BIGINT) * 10 WHEN l_returnflag = 'A' THEN 0 END AS cached_input_tokens,
               l_extendedprice, l_suppkey, l_shipdate
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given or derived table as a DataFrame; ``given`` replaces source tables, by streams for instance."""
    if given and name in given:
        return given[name]
    if name in TABLES:
        return read_table(spark, sf_dir, name)
    sql = BINDINGS[name]
    inputs = {part: bind(spark, sf_dir, part, given) for part in dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql))}
    # Braces of JSON texts are literal; only {name} stands for a DataFrame.
    literal = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\{\{([a-z]\w*)\}\}", r"{\1}", literal), **inputs)


def with_bindings(sql: str) -> str:
    """Checking SQL with ``{name}`` references resolved to CTEs of the same derivations."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", text)):
            if name in BINDINGS and name not in needed:
                visit(BINDINGS[name])
                needed.append(name)

    visit(sql)
    plain = re.sub(r"\{([a-z]\w*)\}", r"\1", sql)
    if not needed:
        return plain
    ctes = ", ".join(f"{name} AS ({re.sub(r'{([a-z]\w*)}', r'\1', BINDINGS[name])})" for name in needed)
    head = re.match(r"\s*WITH (RECURSIVE )?", plain)
    if head:
        return f"WITH {head.group(1) or ''}{ctes}, {plain[head.end():]}"
    return f"WITH {ctes} {plain}"


def bind_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table without shuffles behind it, dealt out over the cores where it is small."""
    return spread(bind(spark, sf_dir, name))


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream, whether it is one parquet file or a folder of them."""
    table = read_table(spark, sf_dir, name)
    files = table.inputFiles()
    stream = spark.readStream.schema(table.schema)
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(f"{sf_dir}/{name}.parquet")


def stored_requests(flat: DataFrame) -> DataFrame:
    """The derived requests in the stored, nested form; only completed rows hold a result."""
    done = F.col("state") == "completed"
    at = F.col("created_at").cast("timestamp")
    classification = F.struct(
        *V.CONTENT_FIELDS, "confianza", "id", F.lit("v1").alias("version_prompt")
    ).cast(schemas.CLASSIFICATION)
    metadata = F.struct(
        F.lit("model-a").alias("model"), F.lit(1).alias("attempt"), F.col("key_number").alias("input_tokens"),
        F.col("key_number").alias("output_tokens"), F.lit(0).cast("long").alias("cached_input_tokens"),
        F.lit(1.5).alias("latency_ms"), F.lit(None).cast("decimal(38,12)").alias("estimated_cost_usd"),
        F.lit("v1").alias("prompt_version"),
    ).cast(schemas.METADATA)
    return flat.select(
        "id", "raw_message", "state",
        F.when(done, classification).alias("ai_classification"),
        F.lit(None).cast(schemas.CONTENT).alias("human_correction"),
        F.when(done, metadata).alias("provider_metadata"),
        F.when(done, F.col("categoria")).alias("effective_category"),
        F.when(done, F.col("prioridad")).alias("effective_priority"),
        F.when(done, F.col("area_sugerida")).alias("effective_area"),
        "failure_code",
        at.alias("created_at"), at.alias("updated_at"), F.when(done, at).alias("classified_at"),
        F.lit(None).cast("timestamp").alias("corrected_at"),
    )
