"""Spark jobs for evaluating language-model outputs at scale."""
