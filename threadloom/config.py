"""Values that a deployment sets: the invented company stands for the one whose agents write."""

COMPANY = "Harbor Lane Lending"
