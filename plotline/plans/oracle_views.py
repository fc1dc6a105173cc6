"""The adapter views once more, as SQL for a second engine (DuckDB), and a helper to prepend them."""

from __future__ import annotations

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
TYPES = "['action_transition','state_change','participant_update','spatial_consequence','object_reveal','visible_text_update']"
QUESTION_TYPES = "['what_happens_next','what_changes_next','what_is_revealed_next','what_text_appears_next']"
EVIDENCE_TYPES = ("['physical_precondition','motion_trajectory','object_affordance','social_cue','dialogue_cue','emotional_cue',"
                  "'scene_script','hazard_cue','other']")
FEATURE_STOP = ("['a','an','and','are','at','be','by','for','from','he','her','hers','him','his','in','is','it','its','of','on',"
                "'she','that','the','their','them','they','this','to','was','were','with']")
OVERLAP_STOP = ("['a','an','the','and','or','of','in','on','at','to','is','are','with','for','into','from','by','as','his','her',"
                "'their','they','he','she','it','its','this','that','these','those','be','been','but','off','out','up','over',"
                "'while','then','next','now']")
PEOPLE = "['man','woman','he','she','they','someone','waiter','couple']"
LOCATIONS = ("['door','hall','hallway','room','street','kitchen','table','car','bed','stairs','office','bar','restaurant']")
ACTIONS = ("['open','close','walk','run','sit','stand','turn','look','pick','hold','raise','unlock','enter','leave','hand','give',"
           "'take','search','pull','push','step','approach','say','ask','smile','stop','drink','eat','drive','knock','call']")


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def compare_key(x: str) -> str:
    return f"lower({squeeze(x)})"


def lookup_key(x: str) -> str:
    once = r"(^|[^\p{L}\p{N}_])([a-z0-9]+)''s($|[^\p{L}\p{N}_])"
    inner = f"regexp_replace(lower({x}), '{once}', '\\1\\2\\3', 'g')"
    return f"regexp_replace(regexp_replace({inner}, '{once}', '\\1\\2\\3', 'g'), '[^a-z0-9]+', '', 'g')"


def sequence_key(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace({x}, '^\\d+_', '')), '[^a-z0-9]+', '', 'g')"


def safe_double(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{NUMBER}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def score(x: str) -> str:
    return f"(CASE WHEN {safe_double(x)} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {safe_double(x)})) END)"


def loose_double(x: str, default: str = "0.0", signed: bool = True) -> str:
    sign = "-?" if signed else ""
    return f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '{sign}\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE), {default}::DOUBLE)"


def loose_bool(x: str, default: str = "false") -> str:
    return (f"(CASE WHEN lower(trim({x})) IN ('true','yes','1','keep') THEN true "
            f"WHEN lower(trim({x})) IN ('false','no','0','','reject') THEN false ELSE {default} END)")


def truthy(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN false WHEN lower(trim({x})) IN ('false','no','0','') THEN false ELSE true END)"


def pick(values: str, index: str) -> str:
    return f"({values})[(({index}) % len({values})) + 1]"


def question_type(label: str, target: str) -> str:
    mapped = ("(CASE {0} WHEN 'action_transition' THEN 'what_happens_next' WHEN 'participant_update' THEN 'what_happens_next' "
              "WHEN 'spatial_consequence' THEN 'what_happens_next' WHEN 'state_change' THEN 'what_changes_next' "
              "WHEN 'object_reveal' THEN 'what_is_revealed_next' WHEN 'visible_text_update' THEN 'what_text_appears_next' END)")
    own = f"trim(coalesce({label},''))"
    return (f"(CASE WHEN list_contains({QUESTION_TYPES}, {own}) THEN {own} ELSE coalesce({mapped.format(own)}, "
            f"{mapped.format(f'trim({target})')}, 'what_happens_next') END)")


def evidence_type(label: str) -> str:
    own = f"trim(coalesce({label},''))"
    aliased = (f"(CASE {own} WHEN 'emotion_cue' THEN 'emotional_cue' WHEN 'emotion_driven' THEN 'emotional_cue' "
               f"WHEN 'social_interaction' THEN 'social_cue' WHEN 'hazard_prediction' THEN 'hazard_cue' "
               f"WHEN 'intent_driven' THEN 'scene_script' ELSE {own} END)")
    return f"(CASE WHEN list_contains({EVIDENCE_TYPES}, {aliased}) THEN {aliased} ELSE 'other' END)"


def reasoning_types(values: str) -> str:
    return (
        f"(CASE WHEN len({values}) > 0 THEN list_transform({values}, lambda r: CASE trim(r) WHEN 'social_cue' THEN 'social_interaction' "
        "WHEN 'emotional_cue' THEN 'social_interaction' WHEN 'emotion_cue' THEN 'social_interaction' "
        "WHEN 'emotion_driven' THEN 'social_interaction' WHEN 'hazard_cue' THEN 'hazard_prediction' "
        "WHEN 'dialogue_cue' THEN 'dialogue_grounded' WHEN 'spatial_setup' THEN 'physical_precondition' "
        "ELSE CASE WHEN trim(r) IN ('physical_precondition','motion_trajectory','object_affordance','social_interaction',"
        "'dialogue_grounded','intent_driven','scene_script','hazard_prediction','other') THEN trim(r) ELSE 'other' END END) "
        "ELSE ['other'] END)"
    )


def continuity_type(label: str, reasoning: str) -> str:
    return (
        f"(CASE WHEN trim({label}) IN ('continuous_physical','continuous_social','dialogue_continuous',"
        f"'scene_cut_semantically_linked','discontinuous_unpredictable') THEN trim({label}) "
        f"WHEN list_has_any({reasoning}, ['physical_precondition','motion_trajectory','object_affordance','scene_script','hazard_prediction']) "
        "THEN 'continuous_physical' "
        f"WHEN list_has_any({reasoning}, ['social_interaction','intent_driven']) THEN 'continuous_social' "
        f"WHEN list_contains({reasoning}, 'dialogue_grounded') THEN 'dialogue_continuous' ELSE 'discontinuous_unpredictable' END)"
    )


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z'']+'), lambda t: lower(t))"


def content_tokens(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: NOT list_contains({FEATURE_STOP}, t))"


def word_set(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z'']+'), "
            f"lambda w: length(w) > 2 AND NOT list_contains({OVERLAP_STOP}, w)))")


def overlap(a: str, b: str) -> str:
    """Overlap of two word-set expressions."""
    return (f"(CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0::DOUBLE "
            f"ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END)")


def people(t: str) -> str:
    return f"list_sort(list_distinct(list_filter({t}, lambda w: starts_with(w, 'person') OR list_contains({PEOPLE}, w))))"


def locations(t: str) -> str:
    return f"list_sort(list_distinct(list_filter({t}, lambda w: list_contains({LOCATIONS}, w))))"


def actions(t: str) -> str:
    return (f"list_sort(list_distinct(list_filter({t}, lambda w: list_contains({ACTIONS}, w) OR ends_with(w, 'ing') "
            "OR ends_with(w, 'ed'))))")


def objects(t: str) -> str:
    return (f"list_sort(list_distinct(list_filter({t}, lambda w: NOT (list_contains({FEATURE_STOP}, w) OR starts_with(w, 'person') "
            f"OR list_contains({PEOPLE}, w) OR list_contains({LOCATIONS}, w) OR list_contains({ACTIONS}, w) "
            "OR ends_with(w, 'ing') OR ends_with(w, 'ed')))))")


REASONING = "[['spatial_setup','motion_trajectory'],['emotion_cue'],['dialogue_cue'],[]::VARCHAR[],['nonsense','intent_driven']]"
EVIDENCE = "['physical_precondition','emotion_driven','hazard_prediction','unheard_of',NULL,' dialogue_cue ']"

CLIP = ("{'clip_id': clip_id, 'sequence_index': sequence_index, 'timestamp_start': timestamp_start, "
        "'timestamp_end': timestamp_end, 'text': text}")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_clips": ((), f"""
        SELECT conv_id, turn, role, movie, sequence_index, start_s, end_s, timestamp_start, timestamp_end, text,
               movie || '__' || replace(timestamp_start, '.', 'p') || '_' || replace(timestamp_end, '.', 'p') AS clip_id
        FROM (SELECT conv_id, turn, role, 'conv_' || conv_id AS movie, turn AS sequence_index,
                     turn * 2.0::DOUBLE AS start_s, turn * 2.0::DOUBLE + 1.5::DOUBLE AS end_s,
                     CAST(turn * 2.0::DOUBLE AS VARCHAR) AS timestamp_start,
                     CAST(turn * 2.0::DOUBLE + 1.5::DOUBLE AS VARCHAR) AS timestamp_end,
                     {squeeze("translate(text, '’“”', '''\"\"')")} AS text
              FROM conversations)"""),
    "v_ordered": (("v_clips",), """
        SELECT *, row_number() OVER (PARTITION BY movie ORDER BY start_s, sequence_index, clip_id) - 1 AS pos FROM v_clips"""),
    "v_blocks": (("v_ordered",), f"""
        SELECT 'seq::' || movie || '::block::' || printf('%05d_%05d', pos, pos + len(clips) - 1) || '::w4' AS block_id,
               movie, conv_id, pos AS block_start, pos + len(clips) - 1 AS block_end, clips
        FROM (SELECT *, list({CLIP}) OVER (PARTITION BY movie ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS clips
              FROM v_ordered)
        WHERE length(trim(array_to_string(list_transform(clips, lambda c: c.text), ' '))) >= 20"""),
    "v_decisions": (("v_blocks",), f"""
        SELECT *,
          {pick("['true','yes','True ','1','keep','no','false']", "conv_id + 3*block_start")} AS found_valid_target,
          CASE WHEN (conv_id + block_start) % 11 <> 0 THEN 2 + (7*conv_id + block_start) % 3 END AS target_position,
          CASE WHEN (conv_id + 2*block_start) % 5 = 0 AND len(clips) >= 2 THEN clips[2].clip_id
               WHEN (conv_id + 2*block_start) % 13 = 1 THEN 'ghost_clip' END AS target_clip_id,
          {pick("list_concat(" + TYPES + ",['dance_move',''])", "5*conv_id + block_start")} AS target_type,
          {pick("['nontrivial','nontrivial','nontrivial','trivial_generic_motion','meaningful_but_noninferable']",
                "2*conv_id + block_start")} AS target_triviality,
          {pick("['predictable','predictable','underdetermined','unpredictable',NULL]", "conv_id + block_start")} AS predictability,
          {pick("['continuous_physical','continuous_social','scene_cut_semantically_linked','garbage',NULL]",
                "3*conv_id + block_start")} AS continuity_raw,
          {pick(REASONING, "conv_id + block_start")} AS reasoning_raw,
          {pick("['0.85','score 0.7','-0.9','','high','1',NULL]", "conv_id + 2*block_start")} AS sufficiency_raw,
          [clips[1].clip_id, coalesce(clips[3].clip_id, 'none'), 'ghost_clip'] AS chosen_ids,
          [{{'clip_id': clips[1].clip_id, 'span': ' ' || string_split(clips[1].text, ' ')[-1],
             'evidence_type': {pick(EVIDENCE, "conv_id + block_start")}}},
           {{'clip_id': clips[least(2, len(clips))].clip_id, 'span': string_split(clips[least(2, len(clips))].text, ' ')[-1],
             'evidence_type': 'motion_trajectory'}},
           {{'clip_id': clips[1].clip_id, 'span': '§ not in the text', 'evidence_type': 'other'}}] AS spans,
          CASE WHEN (conv_id + block_start) % 3 = 0 THEN []::VARCHAR[] ELSE [clips[1].clip_id, 'ghost_clip'] END AS cited_raw,
          (conv_id + block_start) % 7 <> 3 AS called,
          {pick("['keep','reject','true','no','1']", "conv_id + 4*block_start")} AS should_keep_raw
        FROM v_blocks"""),
    "v_resolved": (("v_decisions",), f"""
        SELECT *, CASE WHEN hit > 0 THEN hit END AS pos_in_block, CASE WHEN hit > 0 THEN clips[hit].clip_id END AS tid,
               CASE WHEN hit > 0 THEN clips[hit].text END AS sentence, CASE WHEN hit > 0 THEN clips[hit].timestamp_start END AS tstart,
               {truthy('found_valid_target')} AND hit > 0 AS found,
               CASE WHEN hit > 1 THEN clips[1:hit-1] ELSE clips[1:0] END AS prefix
        FROM (SELECT *, coalesce(list_position(list_transform(clips, lambda c: c.clip_id),
                 coalesce(target_clip_id, CASE WHEN target_position BETWEEN 1 AND len(clips) THEN clips[target_position].clip_id END)), 0) AS hit
              FROM v_decisions)"""),
    "v_reconciled": (("v_resolved",), """
        SELECT *, list_filter(prefix, lambda c: list_contains(merged, c.clip_id)) AS context,
               list_transform(list_filter(prefix, lambda c: list_contains(merged, c.clip_id)), lambda c: c.clip_id) AS selected_ids,
               CASE WHEN len(cited) > 0 THEN cited ELSE list_transform(evidence, lambda e: e.clip_id) END AS evidence_ids
        FROM (SELECT *, list_concat(list_filter(chosen_ids, lambda x: list_contains(list_transform(prefix, lambda c: c.clip_id), x)),
                                    list_transform(evidence, lambda e: e.clip_id)) AS merged,
                     list_filter(cited_raw, lambda x: list_contains(list_transform(prefix, lambda c: c.clip_id), x)) AS cited
              FROM (SELECT *, list_transform(list_filter(spans, lambda e: len(list_filter(prefix, lambda c:
                         c.clip_id = e.clip_id AND length(trim(e.span)) > 0 AND contains(c.text, trim(e.span)))) > 0),
                         lambda e: {'clip_id': e.clip_id, 'span': trim(e.span), 'evidence_type':
                            CASE WHEN trim(e.evidence_type) IN ('physical_precondition','motion_trajectory','object_affordance',
                              'social_cue','dialogue_cue','emotional_cue','scene_script','hazard_cue','other')
                            THEN trim(e.evidence_type) ELSE 'other' END}) AS evidence
                    FROM v_resolved))"""),
    "v_selection": (("v_reconciled",), f"""
        SELECT *, CASE WHEN NOT passes AND (coalesce(target_triviality = 'meaningful_but_noninferable', false)
                                            OR coalesce(predictability = 'underdetermined', false)) THEN 'challenge'
                       WHEN NOT passes THEN 'rejected' WHEN coalesce(predictability = 'underdetermined', false) THEN 'challenge'
                       ELSE 'selected' END AS route,
               block_id || '::' || coalesce(tid, 'no_target') AS id
        FROM (SELECT *, coalesce(found AND tid IS NOT NULL AND length(tid) > 0 AND list_contains({TYPES}, target_type)
                  AND target_triviality = 'nontrivial' AND len(selected_ids) > 0 AND len(evidence) > 0 AND sufficiency >= 0.5
                  AND (NOT antecedent OR list_contains(selected_ids, prefix[-1].clip_id))
                  AND NOT bad AND coalesce(predictability, '') <> 'unpredictable', false) AS passes
              FROM (SELECT *, {loose_double('sufficiency_raw', signed=False)} AS sufficiency,
                       {reasoning_types('reasoning_raw')} AS reasoning,
                       {continuity_type('continuity_raw', reasoning_types('reasoning_raw'))} AS continuity,
                       regexp_matches(lower(trim(coalesce(sentence, ''))),
                         '^(knocking|sending|causing|making|leaving|revealing|showing|then|he|she|it|they|his|her|their) ') AS antecedent,
                       ((lower(trim(target_type)) <> '' AND NOT list_contains({TYPES}, lower(trim(target_type))))
                         OR lower(trim(target_triviality)) IN ('trivial_generic_motion','trivial_static_state',
                            'trivial_redundant_continuation','trivial_low_information')) AS bad
                    FROM v_reconciled))"""),
    "v_items": (("v_ordered",), f"""
        SELECT *, movie || ':' || pos AS id, list_filter(coalesce(prior_raw, []), lambda c: true) AS prior
        FROM (SELECT *, list({CLIP}) OVER (PARTITION BY movie ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS prior_raw,
                     lead(text) OVER (PARTITION BY movie ORDER BY pos) AS next_text FROM v_ordered)
        WHERE pos >= 1"""),
    "v_examples": (("v_items",), f"""
        SELECT *, list_concat(wrong[1:answer_idx], [answer_text], wrong[answer_idx+1:3]) AS options,
               list_concat(kinds[1:answer_idx], ['correct'], kinds[answer_idx+1:3]) AS distractor_metadata,
               CASE WHEN (conv_id + pos) % 4 = 0 THEN
                 [{{'clip_id': context[-1].clip_id, 'span': string_split(context[-1].text, ' ')[-1], 'evidence_type': evidence_label}},
                  {{'clip_id': '', 'span': 'x', 'evidence_type': 'other'}}]
               ELSE [{{'clip_id': context[-1].clip_id, 'span': string_split(context[-1].text, ' ')[-1], 'evidence_type': evidence_label}}]
               END AS evidence_raw,
               {question_type('question_type_raw', 'target_type')} AS question_type,
               {score('expectedness_raw')} AS expectedness,
               list_transform(context, lambda c: c.clip_id) AS context_clip_ids,
               list_transform(context, lambda c: c.text) AS context_sentences,
               [context[-1].clip_id] AS evidence_clip_ids
        FROM (SELECT id, conv_id, role, movie, pos, sequence_index, prior, clip_id AS target_clip_id, text AS target_sentence,
                timestamp_start AS target_start, prior[greatest(len(prior) - (conv_id + pos) % 3, 1):len(prior)] AS context,
                (conv_id + pos) % 4 AS answer_idx,
                CASE WHEN role = 'user' THEN text ELSE 'They say: ' || text END AS answer_text,
                [prior[-1].text, coalesce(next_text, 'Nothing more is said.'), 'The scene ends without a word.'] AS wrong,
                CASE WHEN (conv_id + pos) % 3 = 0 THEN ['entity_swapped','entity_swapped','entity_swapped']
                     ELSE ['already_happened','plausible_unsupported','unrelated'] END AS kinds,
                'What happens next?' AS question,
                {pick("['what_happens_next','state_change','object_reveal','mystery',NULL]", "conv_id + 2*pos")} AS question_type_raw,
                {pick("list_concat(" + TYPES + ",['dance_move'])", "5*conv_id + pos")} AS target_type,
                {pick("['nontrivial','nontrivial','nontrivial','meaningful_but_noninferable']", "2*conv_id + pos")} AS target_triviality,
                {pick("['predictable','predictable','underdetermined','unpredictable']", "conv_id + pos")} AS predictability,
                {pick("['continuous_physical','scene_cut_semantically_linked','garbage',NULL]", "3*conv_id + pos")} AS continuity_raw,
                {pick("['0.55','1.7','-0.2','n/a',NULL,'0.8 ','0.3']", "2*conv_id + pos")} AS expectedness_raw,
                {pick(REASONING, "conv_id + pos")} AS reasoning_raw,
                {pick(EVIDENCE, "conv_id + pos")} AS evidence_label,
                {pick("['0.9','confidence 0.65','','0.72',NULL]", "conv_id + 3*pos")} AS confidence_raw,
                {pick("['0.8','-0.4','0.75 of 1',NULL]", "conv_id + pos")} AS sufficiency_raw,
                {pick("['0.0','0.71','none','1']", "3*conv_id + pos")} AS distractor_raw,
                {pick("['keep','reject','true','no','1','yes','maybe',NULL]", "conv_id + pos")} AS keep_raw,
                {pick("[NULL,NULL,NULL,'multi_answer','context does not support the answer']", "3*conv_id + pos")} AS failure_reason,
                role = 'assistant' AS has_video
              FROM v_items)"""),
    "v_key": (("v_ordered",), """
        SELECT movie || ':' || pos AS id, movie, role, conv_id, pos, (conv_id + pos) % 4 AS answer_idx FROM v_ordered WHERE pos >= 1"""),
    "v_predictions": (("v_ordered",), """
        SELECT id, source, k, ord, CASE WHEN value < 4 THEN value END AS prediction
        FROM (SELECT movie || ':' || pos AS id, s.source, ks.k, t.ord,
                     (conv_id*3 + pos*5 + ks.k + s.number + t.ord - 1) % 5 AS value
              FROM v_ordered
              CROSS JOIN (VALUES ('a',0),('b',1),('c',2)) s(source, number)
              CROSS JOIN (VALUES (0),(1),(2),(4),(8)) ks(k)
              CROSS JOIN (VALUES (1),(2)) t(ord)
              WHERE (conv_id + pos) % 11 <> 4 AND (t.ord = 1 OR role = 'assistant'))"""),
    "v_last": (("v_predictions",), """
        SELECT id, source, k, arg_max({'v': prediction}, ord).v AS prediction FROM v_predictions GROUP BY id, source, k"""),
    "v_timed": ((), f"""
        SELECT *, {sequence_key('movie')} AS key
        FROM (SELECT event_id, user_id, event_type, '1005_User ' || user_id AS movie, start_s,
                     round(start_s + value, 3) AS end_s, event_type || '''s ' || json_extract_string(props, '$.k') AS text
              FROM (SELECT *, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 3) AS start_s FROM events))"""),
    "v_wide": (("v_timed",), """
        SELECT event_id AS ord, 'USER_' || user_id AS movie, round(start_s + shift, 3) AS r_start, round(end_s + shift, 3) AS r_end,
               text AS ground_truth, 'alpha ' || text AS alpha,
               CASE WHEN event_type = 'view' THEN '  ' ELSE '  beta ' || text END AS beta, 'gamma ' || upper(text) || ' ' AS gamma
        FROM (SELECT *, CASE event_type WHEN 'view' THEN 0.01::DOUBLE WHEN 'purchase' THEN -0.01::DOUBLE
                             WHEN 'signup' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS shift
              FROM v_timed WHERE event_type <> 'error')"""),
    "v_generated": (("v_wide",), f"""
        SELECT ord, movie, r_start, r_end, ground_truth, source, trim(text) AS text, {sequence_key('movie')} AS key
        FROM (SELECT ord, movie, r_start, r_end, ground_truth, 'alpha' AS source, alpha AS text FROM v_wide
              UNION ALL SELECT ord, movie, r_start, r_end, ground_truth, 'beta', beta FROM v_wide
              UNION ALL SELECT ord, movie, r_start, r_end, ground_truth, 'gamma', gamma FROM v_wide)
        WHERE trim(text) <> ''"""),
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` with the named views, and those they need, as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered)
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"{head}{ctes},\n{body[5:]}"
    return f"{head}{ctes}\n{body}"
