"""Operations of a large training-data pipeline; nothing outside this subpackage imports it."""
