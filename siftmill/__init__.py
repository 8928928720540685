"""A PySpark engine for curating, labelling, scoring and evaluating text prompts."""
