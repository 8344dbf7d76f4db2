"""Column expressions: everything here takes and returns ``Column`` and runs inside code generation."""
