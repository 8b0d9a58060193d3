"""Accessibility audits of whole page corpora, as Spark jobs."""
