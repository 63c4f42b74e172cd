"""The registered queries of the training-data operators, and the check SQL of those that SQL can express."""

from codequarry.llm import centroids, decontaminate, embedding_dedup, fill_middle, html_crf, linededup, minhash, mixing, quality, sentencepiece_fst, sharding, topk, toxicity

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_sentencepiece": sentencepiece_fst.query,
    "op3_minhash": minhash.query,
    "op4_quality": quality.query,
    "op5_html_text": html_crf.query,
    "op6_line_dedup": linededup.query,
    "op7_sharding": sharding.query,
    "op8_toxicity": toxicity.query,
    "op9_topk": topk.query,
    "op10_mixing": mixing.query,
    "op11_centroids": centroids.query,
    "op12_fill_middle": fill_middle.query,
    "op13_decontamination": decontaminate.query,
}
ORACLE_SQL = {
    "op6_line_dedup": linededup.ORACLE,
    "op9_topk": topk.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
    "op13_decontamination": decontaminate.ORACLE,
}
