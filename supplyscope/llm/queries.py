"""The queries of this subpackage, and the SQL of those that SQL can express."""

from supplyscope.llm import chat, decontaminate, kneser_ney, packing, pii, pitman_yor, quality_rules, secret_scan, simhash, spelling, substrings, toxicity, whitening

QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_chat": chat.op5_chat,
    "op6_quality_classifier": kneser_ney.op6_quality_classifier,
    "op7_pii": pii.op7_pii,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_packing": packing.op9_packing,
    "op10_pitman_yor": pitman_yor.op10_pitman_yor,
    "op11_whitening": whitening.op11_whitening,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE = {"op3_decontaminate": decontaminate.ORACLE}


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
