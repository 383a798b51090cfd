"""The bundled example: three people in four kinds of sources, as text written out by the tests."""

#: The texts of the example's sources, which its numbers depend on.
ATS = """{"candidates": [
 {"applicant_name": "Jane A. Doe", "contact": {"email_address": "jane.doe@example.com", "mobile": "(415) 555-0132"}, "job_title": "Staff Engineer",
  "city": "San Francisco", "state": "CA", "country": "USA", "tags": ["Python", "reactjs", "Kubernetes", "graphql"], "experience_years": 8, "github": "octocat",
  "work_history": [{"org": "Acme Corp", "role": "Staff Engineer", "from": "2021-03", "to": "present", "summary": "Leads the payments platform team."},
                   {"org": "Globex", "role": "Software Engineer", "from": "Jan 2018", "to": "sometime 2021"}],
  "schools": [{"name": "MIT", "degree": "B.S.", "major": "Computer Science", "grad_year": 2017}]},
 {"applicant_name": "Carlos Reyes", "contact": {"email_address": "carlos.reyes@example.com", "mobile": "+1 202 555 0188"}, "job_title": "Backend Engineer",
  "city": "Austin", "state": "TX", "country": "United States", "tags": ["golang", "postgres", "docker", "aws"], "experience_years": 6, "github": "this-handle-surely-does-not-exist-zzz",
  "work_history": [{"org": "Globex", "role": "Backend Engineer", "from": "2019-06", "to": "present"}],
  "schools": [{"name": "UT Austin", "degree": "BS", "major": "Computer Engineering", "grad_year": 2031}]}]}"""
CSV = "name,email,phone,current_company,title\nJane Doe,jane.doe@example.com,+1 415-555-0132,Acme,Senior Engineer\nCarlos Reyes,carlos.reyes@example.com,(202) 555-0188,Globex,Backend Engineer\nSam Lee,,not-a-number,,\n"
NOTES = {
    "carlos.txt": "Carlos Reyes -- backend specialist. Email carlos.reyes@example.com.\nAbout 6 years, mostly Go and Postgres. Also AWS and Docker.\n",
    "jane.txt": "Name: Jane Doe\nStrong candidate. Reachable at jane.doe@example.com or 415-555-0132.\nGitHub: github.com/octocat  |  LinkedIn: linkedin.com/in/jane-doe\nRoughly 8 years experience. Comfortable with Python, React, GraphQL and some Kubernetes.\n",
    "sam.txt": "Name: Sam Lee\nMet at a meetup, very sharp on machine learning and Python.\nNo resume yet; phone is call-me-maybe. About 3 years experience.\n",
}
RESUMES = {
    "carlos_reyes.txt": "Carlos Reyes\nBackend Engineer\nEmail: carlos.reyes@example.com | Phone: +1 202-555-0188\nPortfolio: https://carlosreyes.dev\n\nSummary\nBackend specialist focused on Go services.\n\nSkills\nGo, PostgreSQL, Docker, AWS, Kafka\n\nExperience\nBackend Engineer at Globex (2019-06 to present)\n\nEducation\nBS in Computer Engineering, UT Austin, 2019",
    "jane_doe.txt": "Jane Doe\nSenior Software Engineer\nEmail: jane.doe@example.com | Phone: +1 415-555-0132\nGitHub: github.com/octocat | LinkedIn: linkedin.com/in/jane-doe\nPortfolio: https://jane.dev\n\nSummary\nBackend-leaning full-stack engineer who likes clean data pipelines.\n\nSkills\nPython, React, GraphQL, Kubernetes, Terraform, AWS\n\nExperience\nStaff Engineer at Acme Corp (2021-03 to present)\nJunior Developer at Initech (2016-06 to 2017-12)\n\nEducation\nB.S. in Computer Science, MIT, 2017",
}


def write(folder) -> str:
    (folder / "ats.json").write_text(ATS)
    (folder / "broken.json").write_text('{"candidates": [ this is not json')
    (folder / "candidates.csv").write_text(CSV)
    for name, files in (("notes", NOTES), ("resumes", RESUMES)):
        (folder / name).mkdir()
        for file, text in files.items():
            (folder / name / file).write_text(text)
    return str(folder)
