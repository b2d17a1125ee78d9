"""Training-data operators: license scans, packing, mixing, nearest
neighbours, quality and language models, chat templates, token files and
near-duplicate removal. Nothing outside this package imports it."""
