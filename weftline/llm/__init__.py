"""Training-data operators: mixing, sharding, decontamination, quality, media, near duplicates,
token counts, language-model scoring, repeated-passage removal and secret scans."""
