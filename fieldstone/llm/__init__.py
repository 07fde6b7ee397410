"""Operations of a training-data pipeline: token counts, quality, media, licences, toxicity, search, packing, similarity, BPE, chat."""
