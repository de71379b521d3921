"""Table-to-table operators: state folds, tags, verdicts, content, filters."""
