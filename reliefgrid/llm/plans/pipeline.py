"""pipeline: the stages of corpus_pipeline.py over all documents."""

import corpus_pipeline

NAME = "pipeline"
SQL = corpus_pipeline.ORACLE_SQL
plan = corpus_pipeline.run
