"""Reading and writing versions, and turning source texts into them."""
