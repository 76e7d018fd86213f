"""tabloom: DataFrame jobs for preparing labelled tables and evaluating classifiers at scale."""
