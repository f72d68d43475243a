"""Training-data operators: curation steps for large text corpora, each one a Spark job.

Nothing outside this subpackage imports it; the entry module adds its queries only where it can be imported.
"""
