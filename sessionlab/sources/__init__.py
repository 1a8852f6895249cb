from sessionlab.sources.readers import (  # noqa: F401
    scan_chunked,
    scan_inferred_csv,
    scan_limit,
    scan_multi,
    scan_na_tokens,
    scan_pruned,
    scan_typed_csv,
)
from sessionlab.sources.writers import (  # noqa: F401
    materialize,
    sink_columnar,
    sink_csv,
    sink_scored,
    sink_split,
)
