"""Column builders: pure ``Column -> Column`` expressions that stay inside codegen."""
