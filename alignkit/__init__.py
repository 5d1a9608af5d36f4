"""alignkit: align irregular series to common windows, average, fold, contrast and decompose them."""
