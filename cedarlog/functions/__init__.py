"""Column functions: parsing, masking, context and text helpers, all native expressions."""
