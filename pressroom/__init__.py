"""pressroom: news / web-text corpus curation as Spark jobs over captured tables.

Entry points: :func:`pressroom.plans.collect.collect`, :func:`pressroom.plans.repair.fetch_urls`,
:func:`pressroom.plans.repair.repair_texts`, :func:`pressroom.streaming.ingest.run_available`;
building blocks in ``functions``, ``sources`` and ``operators``.
"""

__version__ = "0.1.0"
