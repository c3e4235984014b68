"""Names, tables, patterns and texts that results must match exactly."""

# The asset dictionary.
TAGS = (
    "TE-301", "TE-302", "TE-303", "TE-304", "TE-305", "TE-306", "TE-307", "TE-308", "TE-309", "TE-310",
    "PT-301", "PT-302", "PT-303", "FT-301", "FT-302", "FT-303", "FV-301", "FV-302", "FV-303", "LT-301", "LT-302",
)
SYSTEMS = ("Cryogenic Column T-301", "Cryogenic Column T-302", "Heat Exchanger E-301", "Reboiler H-301", "Condenser C-301")
FAILURE_MODES = (
    "bearing_overheat", "seal_leakage", "cavitation", "flooding", "dry_bed",
    "cold_leak", "fouling", "catalyst_degradation", "sensor_drift", "valve_stiction",
)

# Equipment topology as (subject, predicate, object).
TOPOLOGY = (
    ("Feed_System_F-101", "feeds", "Cryogenic_Column_T-301"),
    ("Cryogenic_Column_T-301", "has_top_pressure_tag", "PT-301"),
    ("Cryogenic_Column_T-301", "has_bottom_pressure_tag", "PT-302"),
    ("Cryogenic_Column_T-301", "has_top_temp_tag", "TE-301"),
    ("Cryogenic_Column_T-301", "has_bottom_temp_tag", "TE-302"),
    ("Cryogenic_Column_T-301", "has_feed_valve", "FV-301"),
    ("Cryogenic_Column_T-301", "has_reflux_valve", "FV-302"),
    ("Cryogenic_Column_T-301", "has_feed_flow_tag", "FT-301"),
    ("Cryogenic_Column_T-301", "vapor_to", "Cryogenic_Column_T-302"),
    ("Cryogenic_Column_T-301", "liquid_to", "Reboiler_H-301"),
    ("Cryogenic_Column_T-302", "has_top_pressure_tag", "PT-303"),
    ("Cryogenic_Column_T-302", "has_top_temp_tag", "TE-303"),
    ("Cryogenic_Column_T-302", "has_bottom_temp_tag", "TE-304"),
    ("Cryogenic_Column_T-302", "has_feed_valve", "FV-303"),
    ("Cryogenic_Column_T-302", "vapor_to", "Cryogenic_Column_T-303"),
    ("Heat_Exchanger_E-301", "cools", "Cryogenic_Column_T-301"),
    ("Heat_Exchanger_E-301", "has_temp_tag", "TE-305"),
    ("Reboiler_H-301", "heats", "Cryogenic_Column_T-302"),
    ("Reboiler_H-301", "has_temp_tag", "TE-306"),
    ("Condenser_C-301", "condenses", "Cryogenic_Column_T-303"),
    ("Condenser_C-301", "has_pressure_tag", "PT-304"),
)

# Failure-mode entries by tag prefix, as (prefix, failure_mode, severity, occurrence, detection,
# rpn, confidence, cause, recommended_action, source_id).
FAILURE_BASE = (
    ("TE", "bearing_overheat", 8, 4, 6, 192, 0.85, "Lubricant degradation due to extended high-load operation", "Check lubricant level and quality. Schedule bearing inspection within 24 hours.", "fmea_042"),
    ("TE", "sensor_drift", 3, 5, 4, 60, 0.62, "Thermocouple aging causing zero-point drift", "Cross-validate with redundant sensor. Recalibrate if deviation > 2°C.", "fmea_017"),
    ("PT", "flooding", 9, 3, 5, 135, 0.82, "Excessive vapor load causing liquid entrainment", "Reduce feed flow by 10%. Increase reflux ratio. Monitor ΔP trend for 30 min.", "fmea_018"),
    ("FT", "valve_stiction", 6, 4, 7, 168, 0.78, "Control valve stem friction due to packing degradation", "Check valve positioner feedback. Perform stroke test during next maintenance window.", "fmea_055"),
    ("FV", "valve_stiction", 7, 3, 6, 126, 0.80, "Valve packing friction or actuator diaphragm leak", "Inspect actuator diaphragm. Schedule packing replacement.", "fmea_056"),
    ("LT", "dry_bed", 8, 2, 5, 80, 0.71, "Insufficient liquid level due to downstream valve malfunction", "Verify downstream valve positions. Check for level transmitter calibration drift.", "fmea_031"),
)
# The entry of a prefix that is not in the base.
UNKNOWN_FAILURE = ("unknown", None, None, None, None, 0.0, "No FMEA entry found for this tag prefix.", None, "fmea_000")

# Keywords of intents.
INTENTS = {
    "fmea_query": ("alarm", "anomaly", "abnormal", "fault", "failure", "exceed", "threshold", "trip", "warning", "high", "low", "deviation", "spike", "drop", "drift"),
    "status_check": ("status", "current", "reading", "value", "what is", "show", "display", "report", "overview", "summary"),
    "knowledge_query": ("what does", "how to", "explain", "procedure", "manual", "definition", "SOP", "standard", "guideline"),
}

# Words that keep a sentence in a summary.
SUMMARY_KEYWORDS = ("alarm", "fault", "failure", "FMEA", "RPN", "severity", "shutdown", "manual", "inspection", "confidence")

# Phrases a report must not hold, and wordings of irreversible actions.
FORBIDDEN_PHRASES = ("guaranteed", "absolutely certain", "100% sure", "without any doubt")
IRREVERSIBLE = ("shutdown", "emergency stop", "vent", "dump", "immediately close", "immediately open", "without confirmation", "guaranteed", "100% sure")

# Citation patterns, the tag pattern, and where sentences end.
CITATIONS = (r"(?i)\[Source:\s*([^\]]+)\]", r"(?i)\[FMEA\s*#([0-9]+)\]", r"(?i)\(Source:\s*([^)]+)\)", r"(?i)\[Ref:\s*([^\]]+)\]")
TAG_PATTERN, SENTENCE_END = r"[A-Z]{2,}-[0-9]{3}", r"[.!?\n]+"

# Words that mark a table's header row, and the sentence a table row becomes.
HEADER_WORDS = ("failure", "mode", "severity", "cause", "effect", "controls", "detection")
ROW_SENTENCE = (
    "In system/equipment [%s], monitoring tag [%s], the potential failure mode is: [%s]. "
    "The failure effect (consequence) is: [%s], with severity score S=%d. The potential root cause is: [%s]. "
    "Current controls or time-series anomaly signature: [%s]. Detection score D=%d. Overall RPN = %d."
)

# Reverse names of graph relations.
REVERSE_RELATIONS = {"observes": "observed_by", "caused_by": "causes", "mitigated_by": "mitigates"}

# Kalman overrides are parameters; wavelet settings by signal class as (wavelet, level, threshold).
WAVELET_CLASSES = {"pressure": ("db4", 2, "universal"), "flow": ("db6", 2, "universal"), "temperature": ("db4", 4, "universal"), "valve": ("db4", 1, "sure")}

# Texts of training examples.
SFT_INSTRUCTION = (
    "You are an industrial FMEA diagnostic agent for a multi-stage cryogenic distillation system.  Based on the alarm signal and "
    "provided FMEA knowledge, diagnose the most likely failure mode.  Cite sources.  If uncertain, state 'Manual inspection required.'"
)
SFT_INPUT = "Alarm: %s abnormal reading.  System: %s.  Retrieved FMEA context below."
SFT_REFUSAL_INPUT = "Alarm: %s abnormal reading.  No FMEA entries found for this tag in the knowledge base."
SFT_REFUSAL = (
    "Tag %s was not found in the FMEA knowledge base.  Reason: %s.  **Action: manual inspection required.**  "
    "Do NOT attempt to diagnose without verified FMEA data."
)
DPO_PROMPT = "Alarm: %s reading abnormal.  System: %s.  Retrieved FMEA context provided below.  What is the diagnosis?"
DPO_CHOSEN = "[Source: %s] %s\n\n**Recommended action:** %s\nConfidence: %.2f.  If uncertain, manual inspection is required."
DPO_REJECTED = (
    "I think the issue is likely related to %s malfunction.  Try reducing the feed flow by 15%% and see if the alarm clears.  "
    "This is a common fix in distillation columns.  (Note: no FMEA source cited — this is general speculation.)"
)
DPO_REFUSAL_PROMPT = "Alarm: %s abnormal.  Scenario: %s.  Diagnosis?"
DPO_REFUSAL = (
    "FV-999",
    "Unknown valve tag — no FMEA or topology entry exists.",
    "Tag FV-999 is not in the asset dictionary or FMEA knowledge base.  I cannot provide a diagnosis.  **Manual inspection required.**  "
    "Do NOT adjust any valves without verified FMEA guidance.",
    "FV-999 is probably a control valve.  Try opening it to 50% and monitor for 10 minutes.  This is standard practice.",
)

# Prompt texts.
TOPOLOGY_PREAMBLE = (
    "You are an industrial FMEA diagnostic agent for a multi-stage cryogenic distillation system.  Below is the column topology "
    "(equipment connectivity graph).  ALL claims MUST be backed by the provided RAG context and topology.  If you cannot derive a cause "
    "from the given information, respond: 'Unknown — manual inspection required.'  NEVER speculate beyond the provided context.\n\n"
)
TOPOLOGY_INSTRUCTIONS = (
    "\n## Instructions\n"
    "1. Analyse the alarm in the context of the topology and RAG results.\n"
    "2. Match against FMEA entries. Cite each match with [Source: <id>].\n"
    "3. If no match is found, state: 'Unknown — manual inspection required.'\n"
    "4. Output in valid JSON matching the FMEA report schema.\n"
)
REFUSAL_SYSTEM = (
    "You are a conservative industrial FMEA diagnostic agent.  Your primary directive: **do no harm.**\n\n"
    "Rules (strict — violations will be rejected by the guardrails gateway):\n"
    "1. ONLY use information from the provided FMEA context and topology.\n"
    "2. If confidence is below 0.6, explicitly state the uncertainty and recommend manual investigation — never guess.\n"
    "3. NEVER recommend irreversible actions (emergency shutdown, valve closure, venting) without explicit operator confirmation.\n"
    "4. When in doubt, respond: 'Insufficient evidence — manual inspection required.'\n"
    "5. Cite every factual claim with [Source: <id>].\n"
    "6. NEVER output tag names that are not in the provided asset dictionary.\n"
    "7. Abundance values MUST be in [0, 100] %.  Values outside this range indicate a sensor or data-processing error — flag it, don't diagnose it.\n"
)
# Worked examples as (context, query, good response, bad response).
REFUSAL_EXAMPLES = (
    (
        "RAG returned 0 results for tag FV-999. Topology: unknown.",
        "What should we do about FV-999 high temperature alarm?",
        "Tag FV-999 was not found in the FMEA knowledge base or asset dictionary.  I cannot provide a diagnostic recommendation.  "
        "**Action: manual inspection required.**  Please verify the tag in the SCADA system and consult the shift supervisor.",
        "Try reducing the feed flow by 10% and check if the temperature drops.  This is a common fix for valve overheating.",
    ),
    (
        "FMEA entry #042: TE-301 bearing temperature high, possible cause: lubricant degradation.  Confidence: 0.45 (below threshold).",
        "Is TE-301 about to fail? Should we shut down?",
        "FMEA entry #042 [Source: fmea_042] suggests possible lubricant degradation, but the confidence is only 0.45 (below the 0.6 "
        "operational threshold).  **I cannot recommend immediate shutdown based on this evidence alone.**  Suggested next step: dispatch "
        "a vibration analysis technician to TE-301 and obtain a lubricant sample for laboratory analysis before making a shutdown decision.",
        "Yes, shut down immediately.  The bearing is about to fail.",
    ),
    (
        "FMEA entry #018: PT-302 pressure drop across column T-301 exceeds 2.5 bar.  Possible flooding.  Severity=8.  Confidence=0.82.",
        "Column T-301 delta-P is 3.1 bar — what valve adjustment?",
        "FMEA #018 [Source: fmea_018] matches: flooding precursor with S=8, confidence=0.82.  The topology shows T-301 feeds T-302.  "
        "Recommended action: **gradually reduce feed valve FV-301 opening by 5% and increase reflux via FV-302 by 3%** while monitoring "
        "top pressure PT-301 for 10 minutes.  If ΔP does not decrease within 10 minutes, escalate to shift supervisor for possible controlled shutdown.",
        "Fully open FV-301 and close FV-302.  That should fix it.",
    ),
)
EXAMPLE_HEADS = ("### Example %d", "Context: %s", "Query: %s", "\n**CORRECT response:**\n%s", "\n**WRONG response (hallucination — DO NOT DO THIS):**\n%s\n")
NO_CAUSAL_ENTRY = (
    "[FMEA Bilinks] No causal entries found for sensor %s. This may be a newly-added asset. Manual inspection recommended."
)
CAUSAL_HEAD = "[FMEA Bilinks Causal Retrieval] Seed: %s, BFS depth <= %d:"
CAUSAL_LABELS = (("failure_mode", "Potential Failure Mode"), ("root_cause", "Potential Root Cause"), ("mitigation", "Recommended Mitigation"))
FALLBACK_SUMMARY = (
    "⚠ FALLBACK MODE — %s\nAlarm tag %s triggered but AI confidence (%.2f) is below the operational threshold (0.60).\n"
    "Attempted FMEA matches: %d.\n\n**Recommended action:** Dispatch a qualified operator to perform manual inspection of %s and associated equipment.\n"
    "Check the SCADA trend for the preceding 60 minutes for any correlated deviations in upstream/downstream tags.\n\n"
    "This incident will be logged for retrospective FMEA knowledge base enrichment."
)
LOW_CONFIDENCE_LINE = "⚠ CONFIDENCE BELOW THRESHOLD — manual inspection recommended."
TRIM_MARKER = "…[trimmed]…\n"
