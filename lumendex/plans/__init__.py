"""The index: versioned tables and the verbs over them."""
