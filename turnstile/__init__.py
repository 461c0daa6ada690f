"""turnstile — chat-page extraction as Spark jobs.

Pages are shredded once into a ``dom_nodes`` table; every later step
(protect, noise removal, rule probes, clustering, validation, roles,
Markdown) is DataFrame code keyed on ``page_id``.
"""

__version__ = "0.1.0"
