"""Where records come from: landing files, bulk e-mail, events, a paginated REST source."""
