"""Word lists of the text functions, by length so that they read as sets."""

STOP = frozenset("a|as|at|an|be|by|do|in|is|it|of|on|or|to|the|for|and|are|can|has|how|its|use|who|why|uses|from|have|does|into|that|this|what|when|with|using|these|those|where|which|through".split("|"))

#: The first word stands for its group; where groups share a word, the later one has it.
GROUPS = (
    "taxonomy: catalog universe vocabulary ontology concept", "proof: audit trace explanation reason support evidence", "typed: validated contract structured schema",
    "remote: service openrouter api external", "fake: local test-only mock deterministic", "secret: admin header credential token", "container: service testcontainers docker",
    "quality: test ruff pytest mypy typecheck lint", "reset: rerun clean replay", "vector: pgvector semantic embedding", "database: relational storage postgres",
    "claim: statement requirement intent", "only: solely merely just",
)
SYNONYMS = {w: g.split(": ")[0] for g in GROUPS for w in [g.split(": ")[0], *g.split(": ")[1].split()]}
SUFFIXES = ("ing", "ers", "er", "ed", "es", "s")
